"""Importance resampling towards a target distribution over hashed n-grams.

Features are the runs of 1 to `most` words; a feature's bucket is the CRC-32 of its bytes modulo
`buckets`, composed from the words' CRCs (crc32.py). Buckets are counted within tasks (one array
each), then summed. A document's weight is the sum of its buckets' gains towards the target; with a
seeded Gumbel share added, the highest scores are a draw without replacement in proportion to the weights.

Words are `[0-9a-z]` and all beyond ASCII, A-Z lower-cased. Defined results: null and empty texts have
no features and weight 0; a document with a null doc_id counts in the statistics, but has no score and
is never drawn; of rows equal in score and doc_id that with fewer features comes first; repeated rows
count each; without documents there are no rows, without target texts all its counts are 0; texts of
any length are taken whole. Other columns are ignored by `ranked` and kept by `resampled`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, crc32


def bucket_counts(texts: DataFrame, most: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for crc, _ in crc32.runs(*crc32.words(b.column(0)), most):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in common.in_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is under the target; counts start from 1."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (float(corpus.sum()) + n) / ((s + 1) * (float(target.sum()) + n))))


def weighed(docs: DataFrame, gain: np.ndarray, most: int, keep: list[str]) -> tuple[DataFrame, str, str, str]:
    """The columns `keep` of docs with three more, whose names follow: words, features and weight."""
    names = common.unused(docs, "n_words", "n_features", "weight")
    n_buckets = np.uint32(len(gain))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features, weight, n_words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), None
            for crc, text in crc32.runs(*crc32.words(b.column("text")), most):
                features += np.bincount(text, minlength=b.num_rows)
                weight += np.bincount(text, weights=shared.value[crc % n_buckets], minlength=b.num_rows)  # whole numbers, exact in doubles
                n_words = features.copy() if n_words is None else n_words
            added = [pa.array(x.astype(np.int64)) for x in (n_words, features, weight)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *added], names=[*keep, *names])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in names)])
    return common.in_batches(rows, weigh, schema), *names


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x) of a Gumbel variate from the hash of seed and doc_id; null for a null doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _learned(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> np.ndarray:
    return gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))


def _ranked(docs: DataFrame, gain: np.ndarray, most: int, min_words: int, percent: int, seed: int) -> DataFrame:
    rows, n_words, n_features, weight = weighed(docs.select("doc_id", "text"), gain, most, ["doc_id"])
    score = F.col(weight) + gumbel(F.col("doc_id"), seed)
    rows = common.cut(rows.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_features).alias("n_features"), F.col(weight).alias("weight"), score.alias("score")))
    can = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    order = rows.where(can).sort(F.desc("score"), "doc_id", "n_features").withColumn("at", F.monotonically_increasing_id())
    order = common.cut(order)
    part = F.shiftright("at", 33)
    sizes = {r.part: r.n for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each task
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = docs.sparkSession.createDataFrame(before, "part long, before long")
    place = order.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = place.select(*columns, F.when(F.col("rank") <= percent * total // 100, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.where(~can).select(*columns, F.lit(None).cast("long").alias("rank")))


def ranked(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank: 1, 2, ... of the drawn percent of those with min_words."""
    return _ranked(docs, _learned(docs, target, most, buckets), most, min_words, percent, seed)


def resampled(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """The drawn rows of docs with all their columns; rows equal in score and doc_id are drawn together.

    Texts aren't shuffled: the last drawn score and doc_id decide in each row.
    """
    gain = _learned(docs, target, most, buckets)
    drawn = _ranked(docs, gain, most, min_words, percent, seed).where("rank is not null")
    last = drawn.orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    rows, n_words, _, weight = weighed(docs, gain, most, docs.columns)
    score = F.col(weight) + gumbel(F.col("doc_id"), seed)
    high = (score > last.score) | ((score == last.score) & (F.col("doc_id") <= last.doc_id))
    return rows.where((F.col(n_words) >= min_words) & high).select(*docs.columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words; single words as features."""
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), most=1)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The CRC is computed from its definition, byte by byte, once for each different word.
ORACLE = rf"""
WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {crc32.POLYNOMIAL}) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
tw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
words AS MATERIALIZED (SELECT w FROM dw UNION SELECT w FROM tw),
b AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
                lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295), 4294967295) % 10000 AS b
  FROM words, tab),
s AS (SELECT b, sum(n)::DOUBLE AS n FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, sum(n)::DOUBLE AS n FROM tw JOIN b USING (w) GROUP BY b),
g AS MATERIALIZED (
  SELECT i AS b, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
                           / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
  FROM range(10000) x(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
w AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
h AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (r)),
p AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
o AS (
  SELECT *, n_features >= 20 AND score IS NOT NULL AS can,
         row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features) AS place
  FROM p)
SELECT doc_id, n_features, weight, score,
       CASE WHEN can AND place <= 10 * (SELECT count(*) FROM o WHERE can) // 100 THEN place END AS rank
FROM o
"""
