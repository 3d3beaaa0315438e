from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_near_duplicates import by_brute_force

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.common.stored(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, known, lined, single, mixed, pieces = stages(spark, docs)
    assert all(x.columns == docs.columns for x in (known, lined, single, mixed))
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in start.collect() if r.text and any(c.isalpha() for c in r.text)}

    sites = defaultdict(set)
    for r in known.collect():
        for line in r.text.split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add(r.source)
    seen, want = set(), {}
    for r in sorted(known.collect()):
        left = []
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            if not key or len(sites[key]) < 10 or key not in seen:
                left.append(line)
            seen.add(key)
        if left and "\n".join(left).strip() or not r.text.strip():
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in lined.collect()} == want

    components = by_brute_force([(r.doc_id, r.text) for r in lined.collect()])
    assert {r.doc_id for r in single.collect()} == {i for _, i, _, c in components if c == i}

    size, taken = Counter(), Counter()
    for r in single.collect():
        size[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert max(copies.values()) <= 3 and abs(sum(taken.values()) / sum(size.values()) - 1) < 0.1
    assert Counter(r.doc_id for r in pieces.where("piece = 0").collect()) == copies


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "one two three four five six", "en", "s", 1, "x"), (1, "one two three four five six", "en", "s", 1, "y"), (None, "one two three four five six", None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, None), (4, "123", "en", "s", 3, None), (5, "uno due tre quattro cinque sei", "it", None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sid string")
    out = stages(spark, docs)
    assert [x.count() for x in out[:4]] == [7, 4, 4, 2]
    assert all(x.count() == 0 for x in stages(spark, docs.limit(0)))


def test_clashing_columns_come_through(spark):
    names = ["_lang_pred", "_score", "_n_lines", "_n_removed", "_row", "_size", "_members", "_copies", "_key", "_tie", "_own", "size", "members"]
    rows = [(i, f"one two three four five six {i} seven eight", "en", "s", 1, *range(len(names))) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for x in stages(spark, docs)[:-1]:
        assert x.columns == docs.columns and x.count() > 0
        assert all([r[c] for c in names] == list(range(len(names))) for r in x.collect())
