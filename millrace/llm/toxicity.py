"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their beginnings is trained in numpy from confirmed toxic examples and
unlabelled text. With class prior p, its risk is p R+(P) + max(0, R-(U) - p R-(P)): what unlabelled
text adds as negatives is corrected for the toxic texts in it, and where the correction would make
that part negative (overfitting) the step goes back on it instead. The prior is the toxic share of
all labelled training rows.

Words are chosen where the sample's rows are; the driver gets at most `WORDS` of them, and each row's places among these.

The fit uses a bounded sample (`POSITIVES` and `UNLABELLED` documents with the smallest hashes of
their ids, less copies; where ids repeat, one row of each before second ones); every document is scored over its whole text.

Defined results: a null or empty text has no words and gets the score of the intercept; without
toxic examples all scores are that of an intercept of -40, below 1e-17; labels that repeat or disagree
count as toxic if any is; repeated documents are scored each; an empty table gives no rows; texts of any
length are scored whole. `scored` keeps other columns, less one named score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bounds of the training sample, and of the words that get a weight.
POSITIVES, UNLABELLED, WORDS = 3000, 9000, 4096
#: So many distinct rows of one id at most are in the sample.
PER_ID = 1000


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's words and of their beginnings, which inflected forms share."""
    return np.unique(common.word_hashes(text, common.NOT_LETTER, (4, 5, 6)))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        g = self.intercept
        if len(self.words):
            w = features(text)
            at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            g += float(self.weights[at[self.words[at] == w]].sum())
        return float(1 / (1 + np.exp(-np.clip(g, -40, 40))))


def objective(g: np.ndarray, n: int, prior: float) -> tuple[float, np.ndarray]:
    """What a step lowers, and its slope along the scores g of n positive rows and of the unlabelled ones after them."""
    prob = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    minus = np.logaddexp(0, g)  # the logistic loss of calling a row negative
    m = len(g) - n
    rest = minus[n:].mean() - prior * minus[:n].mean()
    if rest < 0:  # overfitted: back on this part alone
        return -rest, np.append(prior / n * prob[:n], -prob[n:] / m)
    return prior * np.logaddexp(0, -g[:n]).mean() + rest, np.append(prior / n * (prob[:n] - 1) - prior / n * prob[:n], prob[n:] / m)


def fit(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Non-negative risk, minimised by Adam over the whole sample. Rows are the places in `words` of the words they have."""
    every = [*positive, *unlabelled]
    row, col = np.repeat(np.arange(len(every)), [len(x) for x in every]), np.concatenate(every)
    n, d = len(positive), len(words)
    theta = np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        _, slope = objective(np.bincount(row, theta[col], len(every)) + theta[d], n, prior)
        grad = np.append(np.bincount(col, slope[row], d), slope.sum())
        grad[:d] += ridge * theta[:d]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Model(words, theta[:d], float(theta[d]))


def select_words(sample: DataFrame, most: int = WORDS) -> np.ndarray:
    """Sorted hashes of the words whose share of documents differs between the classes of sample (toxic, words) by five standard errors.

    Words are counted where the rows are; only the chosen ones come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in (0, 1):
                own = [np.frombuffer(w, np.int64) for w, k in zip(b.column("words").to_pylist(), b.column("toxic").to_pylist()) if k == t]
                word, n = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n * t), pa.array(n * (1 - t))], names=["word", "p", "u"])

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n, m = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = common.in_batches(sample.select("toxic", "words"), count, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u > 2")
    pooled = (F.col("p") + F.col("u")) / (n + m)
    z = F.abs(F.col("p") / n - F.col("u") / m) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n + 1 / m))
    chosen = counts.select("word", z.alias("z")).where("z > 5").orderBy(F.desc("z"), "word").limit(most).collect()
    return np.sort(np.array([r.word for r in chosen], np.int64).view(np.uint64))


def _placed(sample: DataFrame, words: np.ndarray) -> DataFrame:
    """(toxic, doc_id, places): the places in `words` of the words that each row has, as bytes of 16-bit numbers."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.flatnonzero(np.isin(words, np.frombuffer(w, np.uint64), assume_unique=True)).astype(np.uint16).tobytes() for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("digest"), pa.array(made, pa.binary())], names=["toxic", "digest", "places"])

    return common.in_batches(sample.select("toxic", "digest", "words"), place, "toxic int, digest string, places binary")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [features(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(made, pa.binary())], names=["doc_id", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic; both only of rows to learn from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first().p
    order = F.xxhash64(F.lit(11), "doc_id")
    p_ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("toxic"))
    u_ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("toxic"))
    ids = p_ids.unionByName(u_ids)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    made = common.in_batches(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text"), _words, f"doc_id {kind}, toxic int, words binary").distinct()
    # An id may have many rows: one of each id comes first, then second ones, within the same bounds.
    own = Window.partitionBy("toxic", "doc_id").orderBy(F.xxhash64("words"))
    made = common.cut(made.withColumn("n", F.row_number().over(own)).where(F.col("n") <= PER_ID))
    chosen = [made.where(F.col("toxic") == t).select("toxic", "doc_id", "n").orderBy("n", order, "doc_id").limit(most) for t, most in ((1, positives), (0, unlabelled))]
    sample = made.join(F.broadcast(chosen[0].unionByName(chosen[1])), ["toxic", "doc_id", "n"]).select("toxic", "words", F.md5("words").alias("digest"))
    sample = common.cut(sample.dropDuplicates(["toxic", "digest"]))  # copies of a text count once
    if not share or sample.where("toxic = 1").isEmpty():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    words = select_words(sample)
    rows = sorted((r.toxic, r.digest, bytes(r.places)) for r in _placed(sample, words).toLocalIterator())
    p, u = ([np.frombuffer(x, np.uint16).astype(np.int64) for t, _, x in rows if t == k] for k in (1, 0))
    return fit(words, p, u, min(0.9, max(1e-4, share)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but the text, with score."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(map(model.score, b.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], made], names=[*[f.name for f in kept], "score"])

    return common.in_batches(docs, score, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from rows outside the held-out fifth."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~held), labels.where(~held))
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
