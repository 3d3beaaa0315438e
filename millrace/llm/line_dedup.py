"""Removing boilerplate lines by the number of distinct sites that carry them.

Per line (its two hashes) a HyperLogLog sketch of the sites is built; sketches merge by
aggregation, so a line that most documents share never meets in one task. Where the estimate is
clearly above or below the threshold it decides; lines near it get an exact distinct count.
A boilerplate line stays at its first place (least doc_id, then position) and goes everywhere else,
so no content is lost altogether.

Lines are the \\n-separated parts of a text, compared without the white space at their ends; lines
without a word are never removed. Defined results: null texts stay null and have no lines; rows with
a null doc_id keep all of theirs (though they count for the spread); a null site is no site; rows
that repeat an id are treated alike; an empty table gives no rows; texts and lines of any length are
taken whole. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES, LG_K = 10, 12
#: Removed lines whose list of places is broadcast to the documents; more are joined by shuffle.
BROADCAST_PLACES = 250_000


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2")]


def _places(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, site, pos and hashes of every line with a word."""
    lines = docs.select("doc_id", F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(common.SPACE))
    return lines.where(line != "").select("doc_id", "site", "pos", *_hashes(line))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first doc_id, first pos) of the lines that min_sites distinct sites or more carry."""
    places = _places(docs, site)
    spread = common.cut(
        places.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"))
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"), "first")
        .where(F.col("sites") >= _band(min_sites, lg_k)[0])
    )
    low, high = _band(min_sites, lg_k)
    near = spread.where(F.col("sites") <= high).select("h1", "h2")
    near = F.broadcast(near) if common.has_rows_within(near, BROADCAST_PLACES) else near
    exact = places.where("site is not null").join(near, ["h1", "h2"]).groupBy("h1", "h2", "site").count().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    sure = spread.where(F.col("sites") > high).select("h1", "h2")
    return sure.unionByName(exact.select("h1", "h2")).join(spread.select("h1", "h2", "first"), ["h1", "h2"])


def _band(min_sites: int, lg_k: int) -> tuple[int, int]:
    """Estimates between these are too close to the threshold: six standard errors, and one, either way."""
    wide = 6 * 1.04 / math.sqrt(2**lg_k)
    return max(1, math.floor(min_sites * (1 - wide)) - 1), math.ceil(min_sites * (1 + wide)) + 1


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, str, str]:
    """docs with `text` cleaned and two more columns, whose names follow: lines with a word (before), and lines removed."""
    n_lines, n_removed, doc, gone_at, parts, kept = common.unused(docs, "n_lines", "n_removed", "doc", "gone", "parts", "kept")
    lines = common.cut(boilerplate(docs, site, min_sites))
    few = common.has_rows_within(lines, BROADCAST_PLACES)
    gone = (
        _places(docs, site)
        .where("doc_id is not null")
        .join(F.broadcast(lines) if few else lines, ["h1", "h2"])
        .where(~F.col("first").eqNullSafe(F.struct("doc_id", "pos")))
        .select(F.col("doc_id").alias(doc), _place(F.col("pos"), F.col("h1")).alias("place"))
    )
    gone = common.cut(gone.groupBy(doc).agg(F.collect_set("place").alias(gone_at)))
    total = gone.agg(F.sum(F.size(gone_at))).first()[0] or 0
    joined = docs.join(F.broadcast(gone) if total <= BROADCAST_PLACES else gone, F.col("doc_id") == F.col(doc), "left").drop(doc)
    joined = joined.withColumn(parts, F.split("text", "\n"))
    # Places less the removed ones: Spark does that with a hash set, so a text of many lines costs no more for each.
    places = F.transform(parts, lambda line, i: _place(i, F.xxhash64(F.btrim(line, F.lit(common.SPACE)))))
    rows = joined.withColumn(kept, F.when(F.col(gone_at).isNotNull(), F.array_except(places, F.col(gone_at))))
    worded = F.size(F.filter(parts, lambda line: F.btrim(line, F.lit(common.SPACE)) != ""))
    clean = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: F.get(F.col(parts), F.shiftright(p, 32).cast("int"))), "\n"))
    counts = [F.coalesce(F.when(F.col("text").isNotNull(), worded), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(parts) - F.when(F.col(kept).isNotNull(), F.size(kept)), F.lit(0)).cast("long").alias(n_removed)]
    return rows.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns], *counts), n_lines, n_removed


def _place(pos: Column, h1: Column) -> Column:
    """A line's position, and half of its hash: rows that share an id may differ in their lines."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(h1.bitwiseAND(F.lit(0xFFFFFFFF)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    text = F.coalesce("text", F.lit(""))
    rows, n_lines, n_removed = remove_boilerplate(docs)
    return rows.select(
        "doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.md5(text.cast("binary")).alias("md5_left")
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM d),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM l),
b AS (
  SELECT line, min((doc_id, pos)) FILTER (WHERE doc_id IS NOT NULL) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (
  SELECT t.*, b.line IS NOT NULL AND t.doc_id IS NOT NULL AND coalesce((t.doc_id, t.pos) <> b.first, false) AS gone FROM t LEFT JOIN b USING (line)),
k AS (
  SELECT r, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(rest, ''))::BIGINT AS n_chars_left, md5(coalesce(rest, '')) AS md5_left
FROM d LEFT JOIN k USING (r)
"""
