"""A quality classifier by perplexity under interpolated modified Kneser-Ney models of trusted text.

Per language, character n-grams up to `ORDER` of all trusted training documents are counted (a
task adds up its own before the shuffle). Continuation counts, discounts, context weights and the
interpolated probabilities follow order by order from joins of the count tables, which Spark shards
by n-gram. Documents are scored by joins with these tables: each document's n-grams are counted, the
distinct ones of the corpus get their log probability from the tables of every order, and the
products are added up by document. The most frequent n-grams, which nearly every document has and
which would be the hot keys of that join, are the exception: a table of at most `HEAD` of them is
broadcast, and their positions are added up where the text is. Perplexities above a quantile of
held-out trusted documents of the same language are rejected.

Defined results: a null or empty text has no perplexity and isn't kept; a language without trusted
text has no model, and its documents are kept; a null language is one of its own; rows that repeat
are scored each; without labels everything with text is kept; an empty table gives no rows; texts of
any length are scored whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ORDER = 5
#: The most n-grams whose probabilities are broadcast (12 bytes each, and an index of 4 on the workers).
HEAD = 1 << 20
#: A document is rejected above this quantile of its language's held-out trusted documents, times the slack.
QUANTILE, SLACK = 0.99, 1.1
#: Short texts vary more: the limit of a text of n characters is (1 + SHORT / n) times that.
SHORT = 8
_START, _END = 2, 3
_U = np.uint64


def _codes(text: str) -> np.ndarray:
    inner = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.full(ORDER - 1, _START, np.uint32), inner, np.array([_END], np.uint32)])


def _salt(lang: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.md5(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little"))


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k codes, by its last axis or along a flat array."""
    n = codes.shape[-1] - k + 1
    h = np.zeros(codes.shape[:-1] + (max(0, n),), _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * common.M64 + (codes[..., j : j + n].astype(_U) + _U(1))
    return h


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, c): the ORDER-grams of a task's texts, added up by stretches of text."""
    for b in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        held = 0

        def counted():
            for lang, parts in by_lang.items():
                codes = np.concatenate(parts)
                hashes = _rolled(codes, ORDER)
                ends = np.cumsum([len(p) for p in parts])[:-1]
                inside = np.ones(len(hashes), bool)
                for k in range(1, ORDER):  # windows that reach into the next text
                    inside[ends - k] = False
                at = np.flatnonzero(inside)
                _, first, count = np.unique(hashes[at], return_index=True, return_counts=True)
                grams = codes[at[first][:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [grams[i : i + ORDER] for i in range(0, len(grams), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(count, pa.int64())], names=["lang", "g", "c"])

        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(_codes(text))
            held += len(text)
            if held > 8_000_000:
                yield from counted()
                by_lang, held = {}, 0
        yield from counted()


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from the numbers of n-grams seen once to four times."""
    n = counts.groupBy("lang").agg(*[F.count(F.when(F.col("c") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int, here: str, above: str) -> Column:
        usable = (F.col("n1") > 0) & (F.col(here) > 0)
        raw = F.when(usable, k - (k + 1) * y * F.col(above) / F.when(F.col(here) > 0, F.col(here)))
        return F.coalesce(F.when((raw > 0) & (raw < k), raw), F.lit(k / 2)).alias(f"d{k}")

    return n.select("lang", d(1, "n1", "n2"), d(2, "n2", "n3"), d(3, "n3", "n4"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """From counts (lang, g, c) of ORDER-grams, per order k: (lang, g, c, v) with log probabilities v of k-grams, and (lang, h, v) with log weights of the contexts before one."""
    of = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # by how many characters a shorter n-gram is preceded
        of[k] = common.stored(of[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), "grams")
    made, lower = [], None
    for k in range(1, ORDER + 1):
        rows = of[k].join(F.broadcast(_discounts(of[k])), "lang").withColumns(
            {"h": F.substring("g", 1, k - 1) if k > 1 else F.lit(""), "d": F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))}
        )
        contexts = rows.groupBy("lang", "h").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("mass"), F.count("*").alias("kinds"))
        contexts = common.stored(contexts.withColumn("weight", F.col("mass") / F.col("total")), "contexts")
        rows = rows.join(contexts.select("lang", "h", "total", "weight", "kinds"), ["lang", "h"])
        if k == 1:
            rows = rows.withColumn("below", 1 / (F.col("kinds") + 1.0))
        else:
            rows = rows.withColumn("s", F.substring("g", 2, k - 1)).join(lower, ["lang", "s"])
        p = common.stored(rows.select("lang", "g", "c", ((F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), "probabilities")
        lower = p.select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
        floor = F.log(F.col("weight") / (F.col("kinds") + 1.0)) if k == 1 else F.log("weight")  # what is left for unseen characters
        made.append((p.select("lang", "g", "c", F.log("p").alias("v")), contexts.select("lang", "h", floor.alias("v"))))
    return made


def log_probabilities(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, g, v) of distinct (lang, g): the last character of g after the others, by joins with the tables of g's order and below."""
    k = len(tables)
    seen, contexts = tables[-1]
    rows = asked.withColumn("h", F.substring("g", 1, k - 1) if k > 1 else F.lit(""))
    rows = rows.join(seen.select("lang", "g", F.col("v").alias("seen")), ["lang", "g"], "left").join(contexts.select("lang", "h", F.col("v").alias("weight")), ["lang", "h"], "left")
    if k == 1:
        return rows.select("lang", "g", F.coalesce("seen", "weight").alias("v"))
    rest = asked.select("lang", F.substring("g", 2, k - 1).alias("g")).distinct()
    below = log_probabilities(rest, tables[:-1]).select("lang", F.col("g").alias("s"), F.col("v").alias("below"))
    # Not seen as a k-gram: the weight of its context (1 if that wasn't seen either), then the shorter one.
    rows = rows.withColumn("s", F.substring("g", 2, k - 1)).join(below, ["lang", "s"])
    return rows.select("lang", "g", F.coalesce("seen", F.coalesce("weight", F.lit(0.0)) + F.col("below")).alias("v"))


def most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts c, as many whole counts as `most` rows hold; a histogram of counts says which."""
    by_count = grams.groupBy("c").count().withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("c"))))
    least = by_count.where(F.col("upto") <= most).agg(F.min("c").alias("c")).first().c
    return grams.where(F.lit(False) if least is None else F.col("c") >= least)


def _hash_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, grams = (np.array(b.column(c).to_pylist(), object) for c in ("lang", "g"))
        out = np.zeros(len(lang), _U)
        for key in set(lang):
            at = np.flatnonzero(lang == key)
            codes = np.frombuffer("".join(grams[at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), ORDER)
            out[at] = common.mix64(_rolled(codes, ORDER)[:, 0] ^ _salt(key))
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), b.column("v")], names=["h", "v"])


class Lookup:
    """Values by 64-bit hash: sorted keys, found from an index over their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], _U(2**64 - 1)), np.append(values[order], np.float32(np.nan)).astype(np.float32)
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.shift = _U(64 - bits)
        self.start = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=_U) << self.shift).astype(np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """NaN where there is no entry."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        key = self.keys[at]
        out = np.where(key == h, self.values[at], np.float32(np.nan))
        open_ = np.flatnonzero(key < h)
        at = at[open_]
        while len(open_):
            at = at + 1
            key = self.keys[at]
            hit = key == h[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = key < h[open_]
            open_, at = open_[more], at[more]
        return out


_TAIL = pa.list_(pa.struct([("g", pa.string()), ("n", pa.int32())]))


def _head_scores(codes: np.ndarray, lang: str, head: Lookup) -> tuple[float, int, np.ndarray, np.ndarray]:
    """(sum of log probabilities of the n-grams in the head, number of n-grams, the distinct others as rows of codes, their counts)."""
    h = _rolled(codes, ORDER)
    v = head.get(common.mix64(h ^ _salt(lang)))
    open_ = np.flatnonzero(np.isnan(v))
    _, first, count = np.unique(h[open_], return_index=True, return_counts=True)
    return float(np.nansum(v, dtype=np.float64)), len(h), codes[open_[first][:, None] + np.arange(ORDER)], count


def _scorer(shared, key: tuple, langs: list[str], kept: list[str]):
    known = set(langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = common.only_model(key, lambda: Lookup(*shared.value))
        for b in batches:
            total, size, grams, counts, ends = [], [], [], [], [0]
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("text").to_pylist()):
                if text and lang in known:
                    s, n, rest, count = _head_scores(_codes(text), lang, head)
                    joined = rest.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    grams += [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]
                    counts += count.tolist()
                    total.append(s), size.append(n)
                else:
                    total.append(None), size.append(None)
                ends.append(len(grams))
            tail = pa.StructArray.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int32())], names=["g", "n"])
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(total, pa.float64()), pa.array(size, pa.int64()), tail], names=[*kept, "_sum", "_n", "_tail"])

    return score


def perplexities(docs: DataFrame, trusted: DataFrame, head: int = HEAD) -> DataFrame:
    """docs' columns but text (among them _row, a number of the row, and _lang) with _n and perplexity; trusted: lang, text of the training documents."""
    spark = docs.sparkSession
    made = common.in_batches(trusted.where("text <> ''").select(F.coalesce("lang", F.lit("\0")).alias("lang"), "text"), _count_grams, "lang string, g string, c long")
    tables = kneser_ney(common.stored(made.groupBy("lang", "g").agg(F.sum("c").alias("c")), "counts"))
    langs = [r.lang for r in tables[0][1].select("lang").distinct().collect()]
    got = most_frequent(tables[-1][0], head).select("lang", "g", "v").mapInArrow(_hash_entries, "h long, v double").toArrow()
    keys, values = (got[c].to_numpy() for c in ("h", "v"))
    shared = spark.sparkContext.broadcast((keys.view(_U).copy(), values.astype(np.float32)))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_sum double, _n long, _tail array<struct<g: string, n: int>>"])
    key = ("head", uuid.uuid4().hex)
    scored = common.stored(common.in_batches(docs, _scorer(shared, key, langs, [f.name for f in kept]), schema, key), "scored")
    counted = scored.select("_row", F.col("_lang").alias("lang"), F.explode("_tail").alias("x")).select("_row", "lang", "x.g", "x.n")
    asked = common.stored(counted.select("lang", "g").distinct(), "asked")
    sums = counted.join(log_probabilities(asked, tables), ["lang", "g"]).groupBy("_row").agg(F.sum(F.col("n") * F.col("v")).alias("_rest"))
    total = F.col("_sum") + F.coalesce("_rest", F.lit(0.0))
    return scored.drop("_tail").join(sums, "_row", "left").withColumn("perplexity", F.exp(-total / F.col("_n"))).drop("_sum", "_rest")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, head: int = HEAD) -> DataFrame:
    """doc_id, perplexity, kept of docs (doc_id, lang, text); labels: doc_id, quality, where 1 is trusted."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("_good", F.lit(True))
    good = F.broadcast(good) if common.has_rows_within(good, 1_000_000) else good
    held = common.held_out(F.col("doc_id"), 5, 1)
    rows = docs.select("doc_id", "lang", "text").join(good, "doc_id", "left").withColumns({"_good": F.coalesce("_good", F.lit(False)), "_lang": F.coalesce("lang", F.lit("\0"))})
    trusted = rows.where(F.col("_good") & ~held)
    some = (F.col("text").isNotNull() & (F.col("text") != "")).alias("_some")
    scored = perplexities(rows.select("doc_id", "_good", some, "_lang", "text", F.monotonically_increasing_id().alias("_row")), trusted, head)
    scored = common.cut(scored)
    limits = scored.where(F.col("_good") & held & F.col("perplexity").isNotNull()).groupBy("_lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("_limit"))
    limits = common.cut(limits)
    limits = F.broadcast(limits) if common.has_rows_within(limits, 100_000) else limits
    return scored.join(limits, "_lang", "left").select("doc_id", "perplexity", (F.col("_some") & F.coalesce(F.col("perplexity") <= F.col("_limit") * (1 + SHORT / F.col("_n")), F.lit(True))).alias("kept"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
