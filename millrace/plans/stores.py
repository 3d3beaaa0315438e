"""Queries on stored versions, retention by partitions and lookups by id; what they write is the run's own."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions.text import uuid5
from ..operators import telemetry as T
from ..sources import points, retention
from ..sources.publishing import Versions
from ..sources.store import fingerprint, shared
from .base import query, table
from .telemetry import M

STOPS = ("intent", "copied texts", "copied labels", "ready", "switched texts", "switched labels", "done")
AFTER = ("undone", "undone", "undone", "completed", "completed", "completed", "consistent")


@query(
    "ctl_recovery",
    f"WITH s(n, stop, outcome) AS (VALUES {', '.join(str((i, s, a)) for i, (s, a) in enumerate(zip(STOPS, AFTER)))}) SELECT stop, outcome, CASE outcome WHEN 'undone' THEN 'v1' ELSE 'v2' END AS version, (SELECT count(*) FROM documents WHERE outcome <> 'undone' OR doc_id % 2 = 0) AS texts, (SELECT count(*) FROM labels WHERE outcome <> 'undone' OR doc_id % 2 = 0) AS labels FROM s",
)
def ctl_recovery(spark, sf):
    """Two tables are published as v1, then as v2 by runs that die after each step; what readers get after recovery."""
    texts, labels = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("hash")), table(spark, sf, "labels")
    out = None
    for stop in STOPS:
        versions = Versions(spark, f"{shared(spark)}/versions-{uuid.uuid4().hex}", ("texts", "labels"))
        versions.publish("v1", {"texts": texts.where("doc_id % 2 = 0"), "labels": labels.where("doc_id % 2 = 0")})
        for step in versions.publishing("v2", {"texts": texts, "labels": labels}):
            if step == stop:
                break
        outcome = versions.recover()
        counts = versions.read("texts").agg(F.count("*").alias("texts")).crossJoin(versions.read("labels").agg(F.count("*").alias("labels")))
        row = counts.select(F.lit(stop).alias("stop"), F.lit(outcome).alias("outcome"), F.lit(versions.current("texts")).alias("version"), "texts", "labels")
        out = row if out is None else out.unionByName(row)
    return out


@query("tel_expired_days", M + "SELECT created_at::DATE AS day, count(*) AS kept, sum(total_tokens)::BIGINT AS tokens FROM m WHERE created_at::DATE >= DATE '2024-01-31' - 14 GROUP BY 1")
def tel_expired_days(spark, sf):
    """Metrics by day after the days before the last fourteen were dropped."""
    name = f"metrics_{uuid.uuid4().hex}"
    rows = T.metrics(table(spark, sf, "events")).select("request_id", "total_tokens", F.to_date("created_at").alias("day"))
    retention.save_by_day(rows, name)
    retention.expire(spark, name, 14, datetime.date(2024, 1, 31))
    return spark.table(name).groupBy("day").agg(F.count("*").alias("kept"), F.sum("total_tokens").alias("tokens"))


@query("ver_point_lookup", "SELECT doc_id, source, lang, length(text)::INT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id % 5 = 0)")
def ver_point_lookup(spark, sf):
    """Points of a collection by their name-based ids, from files sorted by id."""
    docs = table(spark, sf, "documents")
    path = shared(spark) / f"points-{fingerprint(docs)[:16]}"
    if not path.exists():
        part = shared(spark) / f"points-{uuid.uuid4().hex}"
        points.write(docs.select(uuid5(F.col("doc_id").cast("string")).alias("id"), "doc_id", "source", "lang", F.length("text").alias("chars")), str(part), "id", 8, 256 << 10, 4_000)
        part.moved_to(path)
    wanted = table(spark, sf, "labels").where("toxic = 1 AND doc_id % 5 = 0").select(uuid5(F.col("doc_id").cast("string")).alias("id"))
    return points.lookup(spark, str(path), "id", wanted).select("doc_id", "source", "lang", "chars")
