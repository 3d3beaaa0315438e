"""Term-weight and vector retrieval: index tables, sparse and dense top-k, rank fusion, rescoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import cosine, rrf
from ..functions.text import tokens
from ..sources.store import cut

K1, B = 1.5, 0.75
#: Query vectors that a pass over all vectors holds (more take several passes), and that are multiplied at once.
QUERIES_PER_PASS, QUERY_BLOCK = 131_072, 1024
#: Vectors that are multiplied with a block of queries at once: what a task holds doesn't grow with the tables.
VECTOR_BLOCK = 1024
#: Rows of a small table that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def term_counts(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl). dl is the number of tokens; documents without tokens have no rows.

    only: a table of terms; others are dropped before anything is counted or shuffled.
    """
    rows = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    rows = rows if only is None else rows.join(only, "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def collection_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, avgdl."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def weights(counts: DataFrame, stats: DataFrame, key: str, df: DataFrame | None = None) -> DataFrame:
    """(key, term, idf, weight): BM25 document weights. df: (term, df) where it is known; else it is counted from the same rows, and adaptive joins handle common terms."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")) if df is None else df
    rows = counts.join(df, "term").crossJoin(F.broadcast(stats))
    rows = rows.withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    tf, dl = F.col("tf"), F.col("dl") / F.col("avgdl")
    return rows.select(key, "term", "idf", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl))).alias("weight"))


def frequencies(docs: DataFrame, terms: DataFrame, few: bool, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((term, df) of these terms, (n_docs, avgdl) of all documents), from one reading of the texts where the terms are few: at most BROADCAST_ROWS."""
    every = docs.select(tokens(F.col(text)).alias("t")).select(F.size("t").alias("dl"), F.explode(F.array_prepend(F.array_distinct("t"), F.lit(""))).alias("term"))
    known = terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    counted = every.join(F.broadcast(known) if few else known, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))
    counted = docs.sparkSession.createDataFrame(counted.toArrow()) if few else counted
    # The empty term, which no text has, stands for every document.
    stats = counted.where("term = ''").select(F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("avgdl"))
    return counted.where("term <> ''").select("term", "df"), stats


def query_counts(queries: DataFrame, key: str) -> DataFrame:
    return queries.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def sparse_top(docs: DataFrame, queries: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """k best documents of each query by sums of weight products over shared terms.

    The queries' terms go to the documents first: only their postings are counted and weighed. Query terms weigh as
    documents of length one, with idf again.
    """
    asked = query_counts(queries, query_key)
    terms = asked.select("term").distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    df, stats = frequencies(docs, terms, few)
    terms, df = (F.broadcast(terms), F.broadcast(df)) if few else (terms, df)
    index = weights(term_counts(docs, doc_key, only=terms), stats, doc_key, df)
    asked = small(asked)
    tf = F.col("tf")
    rows = index.join(asked, "term").crossJoin(F.broadcast(stats.select("avgdl")))
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B / F.col("avgdl")))
    scores = rows.groupBy(query_key, doc_key).agg(F.round(F.sum(weight * F.col("weight")), 6).alias("score"))
    return top(scores, query_key, "score", doc_key, k)


def top(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """k best rows of each key, with rank; partitions keep k of each key before the shuffle."""
    best = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    length = np.sqrt((x**2).sum(1, keepdims=True)) if len(column) else np.zeros((0, 1))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of each row, ties to smaller ids; ids is one row for all, or one for each."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:  # what reaches the k-th score, ties included
        level = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        pick = np.argsort(scores < level, axis=1, kind="stable")[:, : int((scores >= level).sum(1).max())]
        scores, ids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _scored(vectors: DataFrame, queries: DataFrame, collector: Callable, schema: str) -> DataFrame:
    """One pass over vectors (vec_id, label, embedding) for all queries (query_id, q_label, q) of a stated set, which every task holds.

    collector(ids, labels, matrix) takes batches by `add` and gives its rows, as arrays of columns, at the end; there is one for each block of queries.
    """
    n, out = queries.count(), None
    passes = max(1, -(-n // QUERIES_PER_PASS))
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        held = part.select("query_id", "q_label", "q").toArrow().combine_chunks()
        ids, labels = (held[c].to_numpy() for c in ("query_id", "q_label"))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, labels, _matrix(pa.concat_arrays(held["q"].chunks) if held["q"].num_chunks else pa.array([], pa.list_(pa.float64())))))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, labels, asked = shared.value
            blocks = [collector(ids[k : k + QUERY_BLOCK], labels[k : k + QUERY_BLOCK], asked[k : k + QUERY_BLOCK]) for k in range(0, len(ids), QUERY_BLOCK)]
            for b in batches:
                for at in range(0, b.num_rows, VECTOR_BLOCK):
                    some = b.slice(at, VECTOR_BLOCK)
                    made = _matrix(some.column("embedding"))
                    for block in blocks:
                        s = block.asked @ made.T
                        np.clip(s, 0, 1, out=s)
                        block.add(some, np.round(s, 6, out=s))
            names = [f.split()[0] for f in schema.split(", ")]
            for block in blocks:
                for rows in block.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)

        got = vectors.select("vec_id", "label", "embedding").mapInArrow(near, schema)
        out = got if out is None else out.unionByName(got)
    return out


class _Nearest:
    """The k best rows of each query so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, asked: np.ndarray, k: int, same: Callable | None):
        self.ids, self.labels, self.asked, self.k, self.same = ids, labels, asked, k, same
        self.score, self.row = np.full((len(ids), k), -1.0), np.zeros((len(ids), k), np.int64)

    def add(self, batch: pa.RecordBatch, s: np.ndarray) -> None:
        vec = batch.column("vec_id").to_numpy()
        s[self.ids[:, None] == vec] = -1
        if self.same is not None:
            s[~self.same(self.labels[:, None], batch.column("label").to_numpy()[None])] = -1
        better = (s.max(1) >= np.maximum(self.score[:, -1], 0)).nonzero()[0]  # the others' k best stay
        if not len(better):
            return
        s = s[better]
        self.score[better], self.row[better] = _best(np.hstack([self.score[better], s]), np.hstack([self.row[better], np.broadcast_to(vec, s.shape)]), self.k)

    def rows(self) -> Iterator[tuple]:
        real = self.score >= 0
        yield np.broadcast_to(self.ids[:, None], self.score.shape)[real], self.row[real], self.score[real]


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, same: Callable | None = None) -> DataFrame:
    """query_id, vec_id, score, rank by cosine. queries is a stated set, (query_id, q, q_label).

    Each task keeps the k best of its rows by array products; only those are shuffled. same(query labels, labels): which pairs count.
    """
    rows = _scored(vectors, queries, lambda *block: _Nearest(*block, k, same), "query_id long, vec_id long, score double")
    return top(rows, "query_id", "score", "vec_id", k)


class _Categories:
    """The best score of each query and label so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, asked: np.ndarray):
        self.ids, self.asked, self.best = ids, asked, {}

    def add(self, batch: pa.RecordBatch, s: np.ndarray) -> None:
        label = batch.column("label").to_numpy()
        s[self.ids[:, None] == batch.column("vec_id").to_numpy()] = -1
        for c in np.unique(label).tolist():
            most = s[:, label == c].max(1)
            self.best[c] = np.maximum(self.best[c], most) if c in self.best else most

    def rows(self) -> Iterator[tuple]:
        for c, most in self.best.items():
            real = most >= 0
            yield self.ids[real], np.full(real.sum(), c, np.int64), most[real]


def dense_categories(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, category, best: the best cosine of each label; each task sends one row of a query and label."""
    return _scored(vectors, queries, _Categories, "query_id long, category long, best double").groupBy("query_id", "category").agg(F.max("best").alias("best"))


def fused(lists: list[DataFrame], query_key: str, doc_key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists; scores of a query are scaled by its best one."""
    rows = lists[0].select(query_key, doc_key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(query_key, doc_key, "rank"))
    summed = rows.groupBy(query_key, doc_key).agg(F.round(F.sum(rrf(F.col("rank"))), 8).alias("rrf"))
    best = F.max("rrf").over(Window.partitionBy(query_key))
    return top(summed, query_key, "rrf", doc_key, k).withColumn("score", F.round(F.col("rrf") / best, 4))


def fused_scores(lists: list[DataFrame], query_key: str, doc_key: str) -> DataFrame:
    """(query, document, rrf) of ranked lists; a query that only one list knows keeps that list's order."""
    rows = lists[0].select(query_key, doc_key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(query_key, doc_key, "rank"))
    return rows.groupBy(query_key, doc_key).agg(F.round(F.sum(rrf(F.col("rank"))), 8).alias("rrf"))


def single(hits: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """Of hits (query, document, rrf) whose texts agree but for case and white space the best; hits without a text go.

    The hits are few: their ids go to the documents, and only those texts' digests come back.
    """
    hits = cut(hits)
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))
    texts = docs.join(small(hits.select(doc_key).distinct()), doc_key, "left_semi").select(doc_key, F.md5(plain).alias("same"), (plain != "").alias("some")).where("some").drop("some")
    first = Window.partitionBy(query_key, "same").orderBy(F.desc("rrf"), doc_key)
    return hits.join(small(cut(texts)), doc_key).withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy", "same")


def rescored(hits: DataFrame, vectors: DataFrame, queries: DataFrame, query_key: str, doc_key: str, k: int, first: int = 10) -> DataFrame:
    """The `first` hits of each query (by rrf) score by cosine, 0 without a vector, the others keep their rrf; of all the k best, ties in the former order."""
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("rrf"), doc_key))
    rows = cut(hits.withColumn("place", place))
    found = cut(vectors.join(small(rows.select(doc_key).distinct()), doc_key, "left_semi"))
    rows = rows.join(small(found), doc_key, "left").join(small(queries), query_key, "left")
    near = F.coalesce(F.round(cosine(F.col("q"), F.col("embedding")), 4), F.lit(0.0))
    rows = rows.select(query_key, doc_key, "place", F.when(F.col("place") <= first, near).otherwise(F.round("rrf", 4)).alias("score"))
    return top(rows, query_key, "score", "place", k).select(query_key, doc_key, "rank", "score")


def filled(hits: DataFrame, payload: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Hits with their empty fields filled from the payload; those whose first column stays empty go."""
    p = payload.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = hits.join(p, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns})
    return rows.where(F.coalesce(F.col(columns[0]), F.lit("")) != "").drop(*[f"_{c}" for c in columns])


__all__ = ["collection_stats", "cosine", "dense_categories", "dense_top", "filled", "frequencies", "fused", "fused_scores", "idf", "query_counts", "rescored", "single", "small", "sparse_top", "term_counts", "top", "weights"]
