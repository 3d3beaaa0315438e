"""Queries over versioned tables; sources of documents stand for versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as V
from .base import query, table

REG = "r AS (SELECT source AS version, source = 'src3' AS is_current, max(doc_id) AS last_id FROM documents GROUP BY source)"


def docs(spark, sf):
    return table(spark, sf, "documents")


def registry(spark, sf):
    return docs(spark, sf).groupBy(F.col("source").alias("version")).agg(F.max("doc_id").alias("last_id")).withColumn("is_current", F.col("version") == "src3")


@query("ver_active_view", f"WITH {REG} SELECT doc_id, lang FROM documents WHERE source = (SELECT version FROM r WHERE is_current)")
def ver_active_view(spark, sf):
    rows = docs(spark, sf).select("doc_id", "lang", F.col("source").alias("version"))
    return V.active(rows, registry(spark, sf)).select("doc_id", "lang")


@query("ver_set_current", f"WITH {REG} SELECT version, version = 'src5' AS is_current, CASE WHEN version = 'src5' THEN TIMESTAMP '2024-02-01 00:00:00' END AS activated_at, CASE WHEN is_current AND version <> 'src5' THEN TIMESTAMP '2024-02-01 00:00:00' END AS rolled_back_at FROM r")
def ver_set_current(spark, sf):
    none = F.lit(None).cast("timestamp_ntz")
    rows = registry(spark, sf).withColumns({"activated_at": none, "rolled_back_at": none})
    return V.with_current(rows, "src5", "2024-02-01 00:00:00").select("version", "is_current", "activated_at", "rolled_back_at")


@query("ver_partition_replace", "SELECT source, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT source, text AS t FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0) UNION ALL SELECT source, text || '!!' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0) GROUP BY source")
def ver_partition_replace(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", "text")
    new = rows.where("source IN ('src1', 'src2') AND doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!!")))
    return V.replaced(rows, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("ver_hash_cache", "SELECT source, count(*) FILTER (WHERE h IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)) AS hits, count(*) FILTER (WHERE h NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)) AS misses FROM (SELECT source, sha1(text) AS h FROM documents) GROUP BY source")
def ver_hash_cache(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", F.sha1("text").alias("hash"))
    return V.cached(rows, rows.where("doc_id % 3 = 0"), "hash").groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("ver_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ver_orphans(spark, sf):
    return V.orphans(docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("ver_manifest", "SELECT coalesce(lang, 'total') AS collection, n, chars, changed FROM (SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE doc_id % 7 = 0) AS changed FROM documents WHERE lang IS NOT NULL GROUP BY ROLLUP (lang))")
def ver_manifest(spark, sf):
    rolled = docs(spark, sf).where("lang IS NOT NULL").rollup("lang")
    return rolled.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("doc_id") % 7 == 0).alias("changed")).select(F.coalesce("lang", F.lit("total")).alias("collection"), "n", "chars", "changed")


@query("ver_delete_guard", f"WITH {REG} SELECT version, NOT is_current AS may_delete FROM r")
def ver_delete_guard(spark, sf):
    return V.may_delete(registry(spark, sf), F.col("version"))


@query("ver_latest_index", "SELECT max(replace(source, 'src', '')::INT) AS latest FROM documents")
def ver_latest_index(spark, sf):
    return docs(spark, sf).agg(F.max(F.replace("source", F.lit("src"), F.lit("")).try_cast("int")).alias("latest"))
