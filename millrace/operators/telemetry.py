"""Request telemetry as dataflows: the fact table, and what dashboards ask of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cost_micro_usd, cost_vnd_cents, percent
from .runs import running_sum

MODELS = ("acme/alpha-large", "acme/alpha-small", "beta-chat", "other")
AS_OF = "2024-01-31 00:00:00"
CRITICAL_VIOLATIONS = 15


def metrics(events: DataFrame) -> DataFrame:
    """Events as rows of the request fact table. Only the columns that a query uses are computed."""
    e = F.col
    rows = events.select(
        e("event_id"),
        F.concat(F.lit("req_"), e("event_id")).alias("request_id"),
        F.when(e("event_id") % 11 != 0, e("user_id")).alias("session_id"),
        F.concat(F.lit("10.0."), e("user_id") % 7, F.lit("."), e("user_id") % 50).alias("client_ip"),
        e("ts").alias("created_at"),
        F.when(e("event_id") % 23 != 0, e("event_type")).alias("intent"),
        (F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) * 10).alias("prompt_tokens"),
        (e("event_id") % 500).cast("long").alias("completion_tokens"),
        F.floor(e("value") * 10).cast("long").alias("total_latency_ms"),
        F.when(e("event_id") % 5 == 0, 0).otherwise(F.floor(e("value") * 3)).cast("long").alias("ttft_ms"),
        (e("event_type") == "view").alias("cache_hit"),
        F.when(e("event_type") == "error", 500).when(e("event_id") % 17 == 0, 429).otherwise(200).alias("status_code"),
        F.element_at(F.array(*map(F.lit, MODELS)), (e("event_id") % 4).cast("int") + 1).alias("model"),
    )
    rows = rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    rows = rows.withColumn("cost_micro_usd", cost_micro_usd(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))
    return rows.withColumn("cost_vnd_cents", cost_vnd_cents(F.col("cost_micro_usd")))


def since(rows: DataFrame, hours: int, as_of: str = AS_OF) -> DataFrame:
    """Rows of the last hours before as_of, as a range that reaches the scan."""
    return rows.where(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {hours} HOURS"))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def overview(rows: DataFrame) -> DataFrame:
    measured = F.nullif(F.col("ttft_ms"), F.lit(0))
    at = lambda c, p: F.coalesce(F.percentile(c, p), F.lit(0.0))
    totals = rows.agg(
        F.count("*").alias("total_requests"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_tokens", "prompt_tokens", "completion_tokens", "cost_micro_usd", "cost_vnd_cents")],
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1).alias(f"avg_{n}_ms") for n, c in (("latency", F.col("total_latency_ms")), ("ttft", measured))],
        *[F.round(at(c, p / 100), 1).alias(f"p{p}_{n}_ms") for n, c in (("latency", F.col("total_latency_ms")), ("ttft", measured)) for p in (50, 95)],
        count_where(F.col("cache_hit")).alias("cache_hits"),
        count_where(F.col("status_code") >= 400).alias("total_errors"),
    )
    total = F.col("total_requests")
    return totals.withColumns({"cache_hit_rate_pct": percent(F.col("cache_hits"), total), "error_rate_pct": percent(F.col("total_errors"), total)})


def by_hour(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost_micro_usd").alias("cost_micro_usd"), F.round(F.avg("total_latency_ms"), 1).alias("avg_latency_ms"), count_where(F.col("status_code") >= 400).alias("errors")
    )


def by_intent(rows: DataFrame) -> DataFrame:
    """NULL stays a group of its own beside one that is named like its label."""
    return rows.groupBy("intent").agg(F.count("*").alias("requests"), F.round(F.avg("total_latency_ms"), 1).alias("avg_latency_ms")).select(F.coalesce("intent", F.lit("general")).alias("intent"), F.col("intent").isNull().alias("unlabelled"), "requests", "avg_latency_ms")


def sessions(rows: DataFrame) -> DataFrame:
    return rows.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost_micro_usd").alias("cost_micro_usd"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.max("client_ip").alias("client_ip")
    )


def top_ips(rows: DataFrame) -> DataFrame:
    limited = F.col("status_code") == 429
    return rows.groupBy("client_ip").agg(F.count("*").alias("requests"), count_where(limited).alias("rate_limited"), count_where((F.col("status_code") >= 400) & ~limited).alias("errors"))


def violations(rows: DataFrame) -> DataFrame:
    """Rate-limited requests with the running count of their address; it never resets."""
    limited = rows.where("status_code = 429")
    out = running_sum(limited, ["client_ip"], F.date_trunc("hour", "created_at"), ["created_at", "event_id"], F.lit(1), "violations")
    return out.withColumn("severity", F.when(F.col("violations") >= CRITICAL_VIOLATIONS, "CRITICAL").otherwise("WARNING"))


def histogram(rows: DataFrame, bounds: tuple[int, ...], column: str) -> DataFrame:
    """Cumulative counts, one row per bound and the total; a single pass over the rows."""
    counts = rows.agg(*[count_where(F.col(column) <= b).alias(f"le_{b}") for b in bounds], F.count(column).alias("le_inf"))
    cells = ", ".join(f"'{b}', le_{b}" for b in (*bounds, "inf"))
    return counts.selectExpr(f"stack({len(bounds) + 1}, {cells}) AS (le, n)")


def insert_new(batch: DataFrame, target: DataFrame, key: str = "request_id") -> DataFrame:
    """The batch rows that an insert which ignores known and repeated keys would add."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")
