"""Queries with ordered state per key, over the batch form of the folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cooldowns import cooldown
from ..operators.telemetry import metrics
from ..streaming import folds
from .base import query, table
from .telemetry import M


def timed(spark, sf):
    rows = metrics(table(spark, sf, "events"))
    return rows.select("event_id", "client_ip", "status_code", "intent", F.unix_millis(F.col("created_at").cast("timestamp")).alias("at_ms"))


@query(
    "st_token_bucket",
    M.replace("WITH m0", "WITH RECURSIVE m0")
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY at_ms, event_id) AS n FROM (SELECT client_ip, event_id, epoch_us(created_at) // 1000 // 60 AS at_ms FROM m)),
b AS (SELECT client_ip, event_id, at_ms, n, true AS allowed, 4.0::DOUBLE AS tokens FROM t WHERE n = 1
  UNION ALL SELECT client_ip, event_id, at_ms, n, k >= 1, k - (k >= 1)::INT FROM (SELECT t.*, least(5.0::DOUBLE, b.tokens + greatest(0, t.at_ms - b.at_ms) * 30.0::DOUBLE / 60000) AS k FROM b JOIN t ON t.client_ip = b.client_ip AND t.n = b.n + 1))
SELECT client_ip, event_id, at_ms, allowed, CASE WHEN allowed THEN 0.0 ELSE round((1 - tokens) * 60 / 30.0::DOUBLE, 3) END::DOUBLE AS retry_after_s FROM b""",
)
def st_token_bucket(spark, sf):
    # Requests of an hour are taken as of a minute, so that the bucket runs empty.
    rows = timed(spark, sf).withColumn("at_ms", F.floor(F.col("at_ms") / 60).cast("long")).select("client_ip", "event_id", "at_ms")
    return folds.batch(rows, "client_ip", folds.token_bucket, folds.BUCKET_OUT)


@query(
    "st_alert_cooldown",
    M.replace("WITH m0", "WITH RECURSIVE m0")
    + """, e AS (SELECT CASE WHEN status_code = 429 THEN 'RATE_LIMIT' ELSE 'SERVER_ERROR' END AS alert_type, event_id, epoch_us(created_at) // 1000 AS at_ms FROM m WHERE status_code >= 400),
s AS (SELECT alert_type, min({'at_ms': at_ms, 'id': event_id}) AS sent FROM e GROUP BY alert_type
  UNION ALL SELECT s.alert_type, min({'at_ms': e.at_ms, 'id': e.event_id}) FROM s JOIN e ON e.alert_type = s.alert_type AND e.at_ms >= s.sent.at_ms + 600000 GROUP BY s.alert_type)
SELECT alert_type, event_id, at_ms, event_id IN (SELECT sent.id FROM s) AS notify FROM e""",
)
def st_alert_cooldown(spark, sf):
    rows = timed(spark, sf).where("status_code >= 400").select(F.when(F.col("status_code") == 429, "RATE_LIMIT").otherwise("SERVER_ERROR").alias("alert_type"), "event_id", "at_ms")
    return cooldown(rows, "alert_type")
