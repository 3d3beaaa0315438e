"""Telemetry queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as T
from ..operators.runs import running_sum
from .base import query, table

#: The fact table in the oracle's SQL.
M = """WITH m0 AS (
  SELECT event_id, 'req_' || event_id AS request_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS session_id,
    '10.0.' || (user_id % 7) || '.' || (user_id % 50) AS client_ip, ts AS created_at, CASE WHEN event_id % 23 <> 0 THEN event_type END AS intent,
    coalesce(regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT, 0) * 10 AS prompt_tokens, event_id % 500 AS completion_tokens,
    floor(value * 10)::BIGINT AS total_latency_ms, CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(value * 3)::BIGINT END AS ttft_ms,
    event_type = 'view' AS cache_hit, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 429 ELSE 200 END AS status_code,
    (['acme/alpha-large', 'acme/alpha-small', 'beta-chat', 'other'])[event_id % 4 + 1] AS model
  FROM events),
m1 AS (SELECT *, prompt_tokens + completion_tokens AS total_tokens,
    (prompt_tokens * CASE event_id % 4 WHEN 0 THEN 250 WHEN 1 THEN 15 WHEN 2 THEN 125 ELSE 50 END
     + completion_tokens * CASE event_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 60 WHEN 2 THEN 500 ELSE 150 END + 50) // 100 AS cost_micro_usd FROM m0),
m AS (SELECT *, (cost_micro_usd * 254 + 50) // 100 AS cost_vnd_cents FROM m1)
"""
WEEK = "created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR"


def facts(spark, sf):
    return T.metrics(table(spark, sf, "events"))


@query(
    "tel_overview",
    M
    + f"""SELECT total_requests, total_tokens, prompt_tokens, completion_tokens, cost_micro_usd, cost_vnd_cents, avg_latency_ms, avg_ttft_ms,
  p50_latency_ms, p95_latency_ms, p50_ttft_ms, p95_ttft_ms, cache_hits, total_errors,
  CASE WHEN total_requests > 0 THEN round(cache_hits / total_requests * 100.0, 2) ELSE 0 END AS cache_hit_rate_pct,
  CASE WHEN total_requests > 0 THEN round(total_errors / total_requests * 100.0, 2) ELSE 0 END AS error_rate_pct FROM (
  SELECT count(*) AS total_requests, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens,
    coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, coalesce(sum(cost_micro_usd), 0)::BIGINT AS cost_micro_usd, coalesce(sum(cost_vnd_cents), 0)::BIGINT AS cost_vnd_cents,
    round(coalesce(avg(total_latency_ms), 0), 1) AS avg_latency_ms, round(coalesce(avg(nullif(ttft_ms, 0)), 0), 1) AS avg_ttft_ms,
    round(coalesce(quantile_cont(total_latency_ms, 0.5), 0), 1) AS p50_latency_ms, round(coalesce(quantile_cont(total_latency_ms, 0.95), 0), 1) AS p95_latency_ms,
    round(coalesce(quantile_cont(nullif(ttft_ms, 0), 0.5), 0), 1) AS p50_ttft_ms, round(coalesce(quantile_cont(nullif(ttft_ms, 0), 0.95), 0), 1) AS p95_ttft_ms,
    count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE status_code >= 400) AS total_errors
  FROM m WHERE {WEEK})""",
)
def tel_overview(spark, sf):
    return T.overview(T.since(facts(spark, sf), 168))


@query(
    "tel_timeseries",
    M
    + f"""SELECT date_trunc('hour', created_at) AS hour, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, sum(cost_micro_usd)::BIGINT AS cost_micro_usd,
  round(avg(total_latency_ms), 1) AS avg_latency_ms, count(*) FILTER (WHERE status_code >= 400) AS errors FROM m WHERE {WEEK} GROUP BY 1""",
)
def tel_timeseries(spark, sf):
    return T.by_hour(T.since(facts(spark, sf), 168))


@query(
    "tel_intents",
    M
    + f"""SELECT coalesce(intent, 'general') AS intent, intent IS NULL AS unlabelled, requests, avg_latency_ms FROM (
  SELECT intent, count(*) AS requests, round(avg(total_latency_ms), 1) AS avg_latency_ms FROM m WHERE {WEEK} GROUP BY intent)""",
)
def tel_intents(spark, sf):
    return T.by_intent(T.since(facts(spark, sf), 168))


@query(
    "tel_logs_page",
    M + "SELECT request_id, created_at, intent, status_code, total_latency_ms, (SELECT count(*) FROM m WHERE intent = 'click' AND NOT cache_hit) AS total FROM m WHERE intent = 'click' AND NOT cache_hit ORDER BY created_at DESC, request_id LIMIT 50 OFFSET 50",
)
def tel_logs_page(spark, sf):
    rows = facts(spark, sf).where((F.col("intent") == "click") & ~F.col("cache_hit"))
    page = rows.orderBy(F.desc("created_at"), "request_id").offset(50).limit(50)
    return page.crossJoin(rows.agg(F.count("*").alias("total"))).select("request_id", "created_at", "intent", "status_code", "total_latency_ms", "total")


@query(
    "tel_sessions",
    M
    + f"""SELECT session_id, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, sum(cost_micro_usd)::BIGINT AS cost_micro_usd, min(created_at) AS first_seen, max(created_at) AS last_seen, max(client_ip) AS client_ip
  FROM m WHERE session_id IS NOT NULL AND {WEEK} GROUP BY session_id ORDER BY last_seen DESC, session_id LIMIT 20""",
)
def tel_sessions(spark, sf):
    return T.sessions(T.since(facts(spark, sf), 168)).orderBy(F.desc("last_seen"), "session_id").limit(20)


@query(
    "tel_top_ips",
    M
    + f"""SELECT client_ip, count(*) AS requests, count(*) FILTER (WHERE status_code = 429) AS rate_limited, count(*) FILTER (WHERE status_code >= 400 AND status_code <> 429) AS errors
  FROM m WHERE {WEEK} GROUP BY client_ip ORDER BY requests DESC, client_ip LIMIT 10""",
)
def tel_top_ips(spark, sf):
    return T.top_ips(T.since(facts(spark, sf), 168)).orderBy(F.desc("requests"), "client_ip").limit(10)


@query("tel_cost_by_model", M + "SELECT model, count(*) AS requests, sum(cost_micro_usd)::BIGINT AS cost_micro_usd, sum(cost_vnd_cents)::BIGINT AS cost_vnd_cents FROM m GROUP BY model")
def tel_cost_by_model(spark, sf):
    return facts(spark, sf).groupBy("model").agg(F.count("*").alias("requests"), F.sum("cost_micro_usd").alias("cost_micro_usd"), F.sum("cost_vnd_cents").alias("cost_vnd_cents"))


@query(
    "tel_alerts_list",
    M + "SELECT request_id, created_at, CASE WHEN status_code = 500 THEN 'SERVER_ERROR' ELSE 'RATE_LIMIT' END AS alert_type, upper(coalesce(intent, 'none')) AS label FROM m WHERE status_code >= 400 AND upper(coalesce(intent, 'none')) = upper('Error') ORDER BY created_at DESC, request_id LIMIT 100",
)
def tel_alerts_list(spark, sf):
    label = F.upper(F.coalesce("intent", F.lit("none")))
    rows = facts(spark, sf).where((F.col("status_code") >= 400) & (label == F.upper(F.lit("Error"))))
    kind = F.when(F.col("status_code") == 500, "SERVER_ERROR").otherwise("RATE_LIMIT")
    return rows.orderBy(F.desc("created_at"), "request_id").limit(100).select("request_id", "created_at", kind.alias("alert_type"), label.alias("label"))


@query(
    "tel_violations",
    M + "SELECT request_id, client_ip, violations, CASE WHEN violations >= 15 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM (SELECT *, count(*) OVER (PARTITION BY client_ip ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS violations FROM m WHERE status_code = 429)",
)
def tel_violations(spark, sf):
    return T.violations(facts(spark, sf)).select("request_id", "client_ip", "violations", "severity")


BOUNDS = (50, 100, 250, 500, 1000, 2000, 3000, 4000)


@query("tel_hist_buckets", M + "SELECT b.le, count(*) FILTER (WHERE total_latency_ms <= b.x) AS n FROM m, (VALUES " + ", ".join(f"('{b}', {b})" for b in BOUNDS) + ", ('inf', 1000000000)) b(le, x) GROUP BY b.le")
def tel_hist_buckets(spark, sf):
    return T.histogram(facts(spark, sf), BOUNDS, "total_latency_ms")


@query(
    "tel_op_totals",
    M + "SELECT coalesce(intent, 'total') AS op, calls, latency_ms, ttft_ms, ttft_calls, tokens FROM (SELECT intent, count(*) AS calls, sum(total_latency_ms)::BIGINT AS latency_ms, sum(ttft_ms)::BIGINT AS ttft_ms, count(*) FILTER (WHERE ttft_ms > 0) AS ttft_calls, sum(total_tokens)::BIGINT AS tokens FROM m WHERE intent IS NOT NULL GROUP BY ROLLUP (intent))",
)
def tel_op_totals(spark, sf):
    rolled = facts(spark, sf).where("intent IS NOT NULL").rollup("intent")
    return rolled.agg(F.count("*").alias("calls"), F.sum("total_latency_ms").alias("latency_ms"), F.sum("ttft_ms").alias("ttft_ms"), F.count_if(F.col("ttft_ms") > 0).alias("ttft_calls"), F.sum("total_tokens").alias("tokens")).select(F.coalesce("intent", F.lit("total")).alias("op"), "calls", "latency_ms", "ttft_ms", "ttft_calls", "tokens")


@query(
    "tel_dedup_insert",
    M + "SELECT request_id, client_ip, status_code FROM m WHERE event_id % 3 <> 0 AND event_id % 2 = 0",
)
def tel_dedup_insert(spark, sf):
    rows = facts(spark, sf).select("event_id", "request_id", "client_ip", "status_code")
    target, batch = rows.where("event_id % 3 = 0"), rows.where("event_id % 2 = 0")
    return T.insert_new(batch.unionByName(batch.where("event_id % 4 = 0")), target).select("request_id", "client_ip", "status_code")


@query(
    "tel_session_touch",
    M + "SELECT session_id, count(*) AS turns, arg_max(request_id, (created_at, event_id)) AS last_request, max(created_at) AS updated_at, count(*) % 7 = 0 AS summarise FROM m WHERE session_id IS NOT NULL GROUP BY session_id",
)
def tel_session_touch(spark, sf):
    rows = facts(spark, sf).where("session_id IS NOT NULL").groupBy("session_id")
    return rows.agg(F.count("*").alias("turns"), F.max_by("request_id", F.struct("created_at", "event_id")).alias("last_request"), F.max("created_at").alias("updated_at")).withColumn("summarise", F.col("turns") % 7 == 0)


@query("tel_retention", M + "SELECT created_at::DATE AS day, count(*) AS kept FROM m WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1")
def tel_retention(spark, sf):
    return T.since(facts(spark, sf), 14 * 24).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("kept"))


@query(
    "tel_chart_scale",
    M + "SELECT day, requests, greatest(6.0, round(100.0 * requests / max(requests) OVER (), 4)) AS height FROM (SELECT created_at::DATE AS day, count(*) AS requests FROM m GROUP BY 1)",
)
def tel_chart_scale(spark, sf):
    days = facts(spark, sf).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"))
    top = days.agg(F.max("requests").alias("top"))
    return days.crossJoin(F.broadcast(top)).select("day", "requests", F.greatest(F.lit(6.0), F.round(100.0 * F.col("requests") / F.col("top"), 4)).alias("height"))


@query(
    "tel_max_overlap",
    M + """, p AS (SELECT created_at AS tm, 1 AS step FROM m UNION ALL SELECT created_at + to_milliseconds(total_latency_ms), -1 FROM m),
r AS (SELECT tm::DATE AS day, step, sum(step) OVER (ORDER BY tm, step ROWS UNBOUNDED PRECEDING) AS open FROM p)
SELECT day, max(greatest(open, open - step))::BIGINT AS most_open FROM r GROUP BY day""",
)
def tel_max_overlap(spark, sf):
    """The most requests open at once on each day, those from the day before among them."""
    rows = facts(spark, sf).select(F.col("created_at").cast("timestamp").alias("t"), "total_latency_ms")
    begin = rows.select(F.col("t").alias("at"), F.lit(1).alias("step"))
    end = rows.select(F.timestamp_micros(F.unix_micros("t") + 1000 * F.col("total_latency_ms")).alias("at"), F.lit(-1).alias("step"))
    steps = running_sum(begin.unionByName(end), [], F.date_trunc("minute", "at"), [F.asc_nulls_last("at"), "step"], F.col("step"), "open")
    return steps.groupBy(F.to_date("at").alias("day")).agg(F.max(F.greatest(F.col("open"), F.col("open") - F.col("step"))).alias("most_open"))


@query("tel_exposition", M + "SELECT 'requests_total{status=\"' || status_code || '\"} ' || count(*) AS line FROM m GROUP BY status_code")
def tel_exposition(spark, sf):
    return facts(spark, sf).groupBy("status_code").agg(F.count("*").alias("n")).select(F.format_string('requests_total{status="%d"} %d', "status_code", "n").alias("line"))
