import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import index as X
from millrace.operators import retrieval as R
from millrace.sources.store import Folder, fingerprint


def corpus(spark, n=4000):
    r = random.Random(1)
    words = [f"w{i}x" for i in range(300)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(300)], k=r.randrange(5, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "rare9"), (-7, "rare9 w0x"), (n + 3, "w0x " * 9)]
    questions = [(q, f"{' '.join(r.choices(words[40:], k=4))}") for q in range(12)] + [(90, "rare9 w0x"), (91, "unheard of"), (92, None), (93, "w0x")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(questions, "q long, text string")


def test_same_rows_as_without_an_index_and_blocks_are_left_out(spark, tmp_path):
    docs, questions = corpus(spark)
    index = X.build(docs, Folder(spark, str(tmp_path / "i")))
    rows = lambda df: sorted(tuple(r) for r in df.select("q", "doc_id", "rank", "score").collect())
    want = rows(R.sparse_top(docs, questions, "q", "doc_id", 5))
    assert rows(X.sparse_top(index, questions, "q", 5, direct=0)) == want and rows(X.sparse_top(index, questions, "q", 5)) == want
    every, _, rest = X.needed(index, X.cut(X.asked_terms(index, questions, "q")), "q", 5)
    later = every.count() - X.FIRST * every.select("q").distinct().count()
    assert rest.count() < later / 2  # most blocks are never read


def test_blocks_and_vectors_are_sorted(spark, tmp_path):
    docs, _ = corpus(spark, 300)
    index = X.build(docs, Folder(spark, str(tmp_path / "i")))
    for r in index.table("postings").collect():
        assert list(r.ids) == sorted(r.ids) and {i // X.BLOCK for i in r.ids} == {r.block} and r.most == max(r.weights) and len(r.ids) == len(r.weights)
    want = {r.doc_id: sorted(r.t) for r in R.term_counts(docs, "doc_id").groupBy("doc_id").agg(F.collect_list("term").alias("t")).collect()}
    assert {r.doc_id: list(r.terms) for r in index.table("vectors").collect()} == want


def test_an_index_is_built_once_for_a_version_of_the_files(spark, tmp_path):
    docs, questions = corpus(spark, 50)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    one = X.opened(spark, read())
    files = one.folder.files()
    assert X.opened(spark, read()).folder.files() == files
    before = fingerprint(read())
    docs.limit(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    assert fingerprint(read()) != before and str(X.opened(spark, read()).folder) != str(one.folder)


def test_empty_documents_and_questions(spark, tmp_path):
    docs, questions = corpus(spark, 20)
    index = X.build(docs.limit(0), Folder(spark, str(tmp_path / "i")))
    assert X.sparse_top(index, questions, "q", 3).count() == X.sparse_top(index, questions, "q", 3, -1).count() == 0
    index = X.build(docs, Folder(spark, str(tmp_path / "j")))
    assert X.sparse_top(index, questions.limit(0), "q", 3).count() == X.sparse_top(index, questions.limit(0), "q", 3, -1).count() == 0


def test_rescoring(spark):
    docs = spark.createDataFrame([(1, "A  b"), (2, "a B "), (3, " "), (4, "c"), (5, "d")], "doc_id long, text string")
    lists = [spark.createDataFrame([(7, 1, 2), (7, 2, 1), (7, 3, 3), (7, 4, 4)], "q long, doc_id long, rank int"), spark.createDataFrame([(7, 4, 1), (8, 5, 1), (8, 4, 2)], "q long, doc_id long, rank int")]
    hits = R.single(R.fused_scores(lists, "q", "doc_id"), docs, "q", "doc_id")
    assert sorted((r.q, r.doc_id) for r in hits.collect()) == [(7, 2), (7, 4), (8, 4), (8, 5)]
    vectors = spark.createDataFrame([(2, [0.0, 1.0]), (4, [1.0, 1.0])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [0.0, 2.0])], "item long, q array<double>")
    got = R.rescored(hits.withColumnRenamed("q", "item"), vectors, queries, "item", "doc_id", 3)
    assert sorted(tuple(r) for r in got.collect()) == [(7, 2, 1, 1.0), (7, 4, 2, 0.7071), (8, 4, 2, 0.0), (8, 5, 1, 0.0)]


def test_an_index_is_written_once_and_rows_of_one_id_are_one_document(spark, tmp_path):
    docs, _ = corpus(spark, 100)
    more = spark.createDataFrame([(3, "w0x rare9"), (70_000, "w0x"), (None, "w0x w0x"), (None, "w1x")], "doc_id long, text string")
    for i, rows in enumerate((docs, docs.unionByName(more))):
        index = X.build(rows, Folder(spark, str(tmp_path / f"i{i}")))
        assert index.folder.names() == ["postings", "stats"]
        n, length = rows.count(), R.term_counts(rows, "doc_id").agg(F.sum("tf")).first()[0]
        stats = spark.createDataFrame([(n, length / n)], "n_docs long, avgdl double")
        each = lambda df: sorted((str(r.doc_id), r.term) for r in df.collect())
        assert each(index.table("weights")) == each(R.term_counts(rows, "doc_id"))
        if i == 0:  # the length of a document of several rows isn't fixed
            got = {(r.doc_id, r.term): r.weight for r in index.table("weights").collect()}
            assert all(abs(got[r.doc_id, r.term] - r.weight) < 1e-12 for r in R.weights(R.term_counts(rows, "doc_id"), stats, "doc_id").collect())
        for r in index.table("postings").collect():
            assert (r.block is None) == (r.ids == [None]) and (r.block is None or {x // X.BLOCK for x in r.ids} == {r.block})
        df = {r.term: r.n for r in R.term_counts(rows, "doc_id").groupBy("term").agg(F.count("*").alias("n")).collect()}
        assert {r.term: r.df for r in index.table("postings").select("term", "df").distinct().collect()} == df


def test_what_a_worker_makes_at_once_is_bounded(monkeypatch):
    """However many ids a batch of a common term's rows has, and however long the texts of a slice are."""
    monkeypatch.setattr(X, "RANGE", 64)
    n = [*[16] * 40, *[1] * 5, *[64, 3] * 3]
    terms = ["the"] * 40 + [f"x{i}" for i in range(5)] + ["y"] * 6
    part = [i // 4 for i in range(40)] + [0] * 5 + [0, 1, 2, 3, 4, 5]
    ids = [list(range(64 * p + 16 * (i % 4), 64 * p + 16 * (i % 4) + k)) if i < 40 else list(range(64 * p, 64 * p + k)) for i, (p, k) in enumerate(zip(part, n))]
    one, nine = [[1] * k for k in n], [[9] * k for k in n]
    rows = pa.table({"term": terms, "range": part, "ids": ids, "tfs": one, "dls": nine, "df": [5] * len(n), "idf": [0.5] * len(n)})
    for at_once in (len(n), 7):
        made = list(X._blocked(9.0)(iter(rows.to_batches(max_chunksize=at_once))))
        assert max(len(b.column("ids").flatten()) for b in made) <= 128
        got = [(r["term"], r["block"], i) for b in made for r in b.to_pylist() for i in r["ids"]]
        assert got == [(t, i // X.BLOCK, i) for t, of in zip(terms, ids) for i in of]
        blocks = [(t, b) for t, b, _ in got]
        assert sum(b.num_rows for b in made) == len(set(blocks))  # a block is one row
    sizes = []
    monkeypatch.setattr(X, "TOKENS", 50)
    monkeypatch.setattr(X.np, "unique", lambda x, f=X.np.unique, **k: (sizes.append(len(x)), f(x, **k))[1])
    docs = [["a"] * 40, [], ["b", "a"], ["a", "c"] * 30, ["c"], ["d"] * 120, [], ["a"]]
    lists = [r for b in X._counted(iter([pa.record_batch({"id": pa.array(range(8)), "t": pa.array(docs, pa.list_(pa.string()))})])) for r in b.to_pylist()]
    assert max(sizes) <= 50 + 120 and len(sizes) > 1
    counts = {(r["term"], i): (tf, dl) for r in lists for i, tf, dl in zip(r["ids"], r["tfs"], r["dls"])}
    assert counts == {(t, i): (d.count(t), len(d)) for i, d in enumerate(docs) for t in d}
