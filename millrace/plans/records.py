"""Queries on records that are kept: sessions, logs, caches, manifests, alerts, prices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as Q
from ..operators import versions as V
from ..operators.catalog import attributes, merged
from ..sources import sinks
from .base import query, table
from .catalog import RANGES
from .telemetry import M, facts


def sessions(spark, sf):
    rows = facts(spark, sf).where("session_id IS NOT NULL").groupBy("session_id")
    return rows.agg(F.count("*").alias("turns"), F.max("created_at").alias("updated_at"), F.max_by("intent", F.struct("created_at", "event_id")).alias("summary"))


SESSIONS = M + ", s AS (SELECT session_id, count(*) AS turns, max(created_at) AS updated_at, arg_max(coalesce(intent, '<none>'), (created_at, event_id)) AS summary FROM m WHERE session_id IS NOT NULL GROUP BY session_id)"


@query("st_session_read", SESSIONS + " SELECT a AS session_id, coalesce(turns, 0) AS turns, updated_at FROM (VALUES (3), (7), (999999)) v(a) LEFT JOIN s ON a = session_id")
def st_session_read(spark, sf):
    """Sessions by id; one that isn't known is empty."""
    asked = spark.createDataFrame([(3,), (7,), (999_999,)], "session_id long")
    rows = sessions(spark, sf).join(F.broadcast(asked), "session_id", "left_semi")
    return asked.join(rows, "session_id", "left").select("session_id", F.coalesce("turns", F.lit(0)).alias("turns"), "updated_at")


@query("st_summary_update", SESSIONS + " SELECT session_id, turns, CASE WHEN turns % 7 = 0 THEN 'summary of ' || turns ELSE 'old' END AS summary, CASE WHEN turns % 7 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE updated_at END AS updated_at FROM s")
def st_summary_update(spark, sf):
    """Summaries that are due, after every seventh turn, are written into known sessions; their turns stay."""
    old = sessions(spark, sf).withColumn("summary", F.lit("old"))
    due = old.where("turns % 7 = 0").select("session_id", F.concat(F.lit("summary of "), "turns").alias("summary"), F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'").alias("updated_at"))
    unknown = spark.createDataFrame([(999_999, "nobody's", None)], "session_id long, summary string, updated_at timestamp_ntz")
    return sinks.updated(old, due.unionByName(unknown), ["session_id"]).select("session_id", "turns", "summary", "updated_at")


@query("st_run_log", M + "SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN 'run-' || event_id % 3 END, 'default') AS run_id FROM m WHERE coalesce(CASE WHEN event_id % 4 <> 0 THEN 'run-' || event_id % 3 END, 'default') NOT IN ('run-1')")
def st_run_log(spark, sf):
    """A log by run, after one run was cleared; entries without a run have the default one."""
    run = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("run-"), F.col("event_id") % 3))
    return facts(spark, sf).select("event_id", F.coalesce(run, F.lit("default")).alias("run_id")).where("run_id <> 'run-1'")


@query("tel_elapsed", M + "SELECT event_id, date_diff('millisecond', created_at, created_at + to_milliseconds(total_latency_ms)) AS elapsed_ms, CASE WHEN ttft_ms > 0 THEN date_diff('millisecond', created_at, created_at + to_milliseconds(ttft_ms)) END AS first_ms FROM m")
def tel_elapsed(spark, sf):
    rows = facts(spark, sf).select("event_id", "total_latency_ms", "ttft_ms", F.timestamp_millis(F.unix_millis(F.col("created_at").cast("timestamp"))).alias("t"))
    after = lambda c: F.timestamp_millis(F.unix_millis("t") + F.col(c))
    return rows.select("event_id", F.timestamp_diff("MILLISECOND", "t", after("total_latency_ms")).alias("elapsed_ms"), F.when(F.col("ttft_ms") > 0, F.timestamp_diff("MILLISECOND", "t", after("ttft_ms"))).alias("first_ms"))


@query("tel_client_address", M + "SELECT event_id, client_ip AS address, event_id % 4 = 0 OR event_id % 4 = 1 OR event_id % 8 = 2 AS exempt FROM m")
def tel_client_address(spark, sf):
    """Who sent a request, behind proxies, and whether its path is outside the limits."""
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "client_ip", F.lit(" , 10.9.9.9"))).otherwise(F.lit(""))
    peer = F.when(F.col("event_id") % 2 == 0, "10.8.8.8").otherwise(F.col("client_ip"))
    path = F.element_at(F.array(*map(F.lit, ("/static/a.js", "/api/admin/x", "/ready", "/api/chat", "/static", "/api/admin", "/api/ready", "/healthz2"))), (F.col("event_id") % 8 + 1).cast("int"))
    exempt = path.startswith("/static") | path.isin("/api/health", "/healthz", "/ready") | path.startswith("/api/admin")
    return facts(spark, sf).select("event_id", Q.client_address(forwarded, peer).alias("address"), exempt.alias("exempt"))


@query("tel_alert_message", M + "SELECT event_id, coalesce(intent, 'UNKNOWN_ALERT') AS alert_type, upper(CASE WHEN event_id % 3 <> 0 THEN 'critical' ELSE 'WARNING' END) AS severity, CASE WHEN event_id % 5 = 0 THEN 'own title' ELSE 'System alert (' || CASE WHEN event_id % 3 <> 0 THEN 'CRITICAL' ELSE 'WARNING' END || ')' END AS title FROM m WHERE status_code >= 400")
def tel_alert_message(spark, sf):
    severity = F.upper(F.coalesce(F.when(F.col("event_id") % 3 != 0, "critical"), F.lit("WARNING")))
    rows = facts(spark, sf).where("status_code >= 400").select("event_id", F.coalesce("intent", F.lit("UNKNOWN_ALERT")).alias("alert_type"), severity.alias("severity"))
    return rows.withColumn("title", F.coalesce(F.when(F.col("event_id") % 5 == 0, "own title"), F.concat(F.lit("System alert ("), "severity", F.lit(")"))))


@query("tel_json_path", "SELECT event_id, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::INT AS k, 2 AS parts FROM events")
def tel_json_path(spark, sf):
    """A value and the length of a list deep in a document."""
    doc = F.concat(F.lit('{"vector": {"collections": {"a": '), "props", F.lit('}}, "tables": [{"rows": 1}, {"rows": 2}]}'))
    rows = table(spark, sf, "events").select("event_id", F.from_json(doc, "vector struct<collections: map<string, struct<k: int>>>, tables array<struct<rows: int>>").alias("m"))
    return rows.select("event_id", F.element_at("m.vector.collections", F.lit("a"))["k"].alias("k"), F.size("m.tables").alias("parts"))


@query("ver_cache_put", "SELECT h AS hash, min(doc_id) AS doc_id FROM (SELECT sha1(text) AS h, doc_id FROM documents) GROUP BY h")
def ver_cache_put(spark, sf):
    """A cache by content hash after the rows that it lacked were put into it; the least id of a hash counts."""
    rows = table(spark, sf, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    cache = rows.where("doc_id % 3 = 0")
    misses = V.cached(rows, cache, "hash").where("NOT hit").drop("hit")
    return cache.unionByName(misses)


@query(
    "ver_manifest_upsert",
    "SELECT source AS version, CASE WHEN source IN ('src2', 'src4') THEN 'new' ELSE 'old' END AS notes, count(*) + CASE WHEN source IN ('src2', 'src4') THEN 1000 ELSE 0 END AS rows, source = 'src2' AS is_current FROM documents GROUP BY source UNION ALL SELECT 'v99', 'new', 7, false",
)
def ver_manifest_upsert(spark, sf):
    """The registry of versions after manifests were recorded: they overwrite all but what is current, and are never current by themselves."""
    counts = table(spark, sf, "documents").groupBy(F.col("source").alias("version")).agg(F.count("*").alias("rows"))
    old = counts.select("version", F.lit("old").alias("notes"), "rows", (F.col("version") == "src2").alias("is_current"))
    new = counts.where("version IN ('src2', 'src4')").select("version", F.lit("new").alias("notes"), (F.col("rows") + 1000).alias("rows"), F.lit(False).alias("is_current"))
    new = new.unionByName(spark.createDataFrame([("v99", "new", 7, False)], "version string, notes string, rows long, is_current boolean"))
    return sinks.upserted(old, new, ["version"], keep=("is_current",))


@query("ver_point_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 101 WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def ver_point_upsert(spark, sf):
    """Points after two batches were written over them; of repeated ids the later batch counts."""
    points = table(spark, sf, "embeddings").select("vec_id", "label")
    batches = points.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("batch"))
    later = points.where("vec_id % 10 = 0").select("vec_id", (F.col("label") + 101).alias("label"), F.lit(2).alias("batch"))
    return sinks.upserted(points, batches.unionByName(later), ["vec_id"], order="batch")


@query("ver_dimensions", "SELECT label, max(len(embedding))::INT AS dimensions, count(*) AS points FROM embeddings GROUP BY label")
def ver_dimensions(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dimensions"), F.count("*").alias("points"))


ALIASES = (("en", "english"), ("de", "german"))


@query("ver_collection_names", "SELECT coalesce(a, lang) || '_v' || max(replace(source, 'src', '')::INT) AS collection, count(*) AS n FROM documents LEFT JOIN (VALUES ('en', 'english'), ('de', 'german')) v(l, a) ON l = lang WHERE lang IS NOT NULL GROUP BY lang, a")
def ver_collection_names(spark, sf):
    """Physical names of collections: the stem's alias and its latest version."""
    stems = F.create_map(*[F.lit(x) for pair in ALIASES for x in pair])
    rows = table(spark, sf, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.max(F.replace("source", F.lit("src"), F.lit("")).try_cast("int")).alias("v"), F.count("*").alias("n"))
    return rows.select(F.concat(F.coalesce(F.try_element_at(stems, F.col("lang")), "lang"), F.lit("_v"), "v").alias("collection"), "n")


@query("cat_price_rows", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS promo, CASE WHEN p_size % 4 = 0 THEN 'f' ELSE 't' END AS vat_included, CASE WHEN p_size % 5 = 0 THEN '' ELSE '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS valid_from, CASE WHEN p_size % 5 = 0 THEN DATE '1970-01-01' ELSE make_date(2024, 1, p_size % 28 + 1) END AS from_date FROM part")
def cat_price_rows(spark, sf):
    """Rows of a price list as text: null is empty, true and false are t and f, what isn't said of taxes is true; dates that are missing get a sentinel."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(size % 3 != 0, size).alias("promo"), F.when(size % 4 == 0, False).when(size % 4 == 1, True).alias("vat"), F.when(size % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))).alias("valid_from")
    )
    text = rows.select("p_partkey", F.coalesce(F.col("promo").cast("string"), F.lit("")).alias("promo"), F.when(F.coalesce("vat", F.lit(True)), "t").otherwise("f").alias("vat_included"), F.coalesce("valid_from", F.lit("")).alias("valid_from"))
    return text.withColumn("from_date", F.coalesce(F.col("valid_from").try_cast("date"), F.lit("1970-01-01").cast("date")))


@query(
    "cat_extractions",
    "SELECT p_brand, spec_key, v FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, spec_key ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_brand, 'size' AS spec_key, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, p_brand, 'price', round(p_retailprice, 2) FROM part) WHERE (spec_key = 'size' AND v BETWEEN 5 AND 45) OR (spec_key = 'price' AND v BETWEEN 950 AND 1500)) WHERE n = 1",
)
def cat_extractions(spark, sf):
    """Extracted values in their ranges, the first of each key and product."""
    ranges = spark.createDataFrame(list(RANGES), "spec_key string, lo int, hi int")
    rows = attributes(table(spark, sf, "part")).withColumn("v", F.col("spec_value").try_cast("double")).join(F.broadcast(ranges), "spec_key").where("v BETWEEN lo AND hi")
    best = rows.groupBy(F.col("model").alias("p_brand"), "spec_key").agg(F.min_by("v", "p_partkey").alias("v"))
    return best


@query("txt_tags", "SELECT doc_id, list_filter([lang, CASE WHEN length(text) > 500 THEN 'long' END, source], lambda x: x IS NOT NULL AND x <> '') AS tags FROM documents")
def txt_tags(spark, sf):
    tags = F.array("lang", F.when(F.length("text") > 500, "long"), "source")
    return table(spark, sf, "documents").select("doc_id", F.filter(tags, lambda x: x.isNotNull() & (x != "")).alias("tags"))


@query("tel_sessions_due", SESSIONS + " SELECT count(*) AS sessions, count(*) FILTER (WHERE turns % 7 = 0) AS due FROM s")
def tel_sessions_due(spark, sf):
    return sessions(spark, sf).agg(F.count("*").alias("sessions"), F.count_if(F.col("turns") % 7 == 0).alias("due"))


SNAPSHOTS = (("pinned-7", "src3", "v1"), (None, "src3", "v1"), (None, "nowhere", "v1"), (None, "nowhere", None))


@query(
    "ver_snapshot_cases",
    "SELECT v.n, coalesce(pinned, (SELECT source || '@' || max(doc_id) FROM documents WHERE source = current GROUP BY source), manifest, 'unknown') AS snapshot FROM (VALUES (0, 'pinned-7', 'src3', 'v1'), (1, NULL, 'src3', 'v1'), (2, NULL, 'nowhere', 'v1'), (3, NULL, 'nowhere', NULL)) v(n, pinned, current, manifest)",
)
def ver_snapshot_cases(spark, sf):
    """What data an answer rests on: the pinned id, else the current version with its date, else the manifest's, else unknown."""
    asked = spark.createDataFrame([(n, *x) for n, x in enumerate(SNAPSHOTS)], "n int, pinned string, current string, manifest string")
    versions = table(spark, sf, "documents").groupBy(F.col("source").alias("current")).agg(F.max("doc_id").alias("at"))
    rows = asked.join(versions, "current", "left")
    return rows.select("n", F.coalesce("pinned", F.when(F.col("at").isNotNull(), F.concat("current", F.lit("@"), "at")), "manifest", F.lit("unknown")).alias("snapshot"))


@query(
    "ver_rollback",
    "SELECT DISTINCT source AS version, source = 'src3' AS is_current, CASE WHEN source = 'src3' THEN TIMESTAMP '2024-03-01 00:00:00' WHEN source = 'src5' THEN TIMESTAMP '2024-02-01 00:00:00' END AS activated_at, CASE WHEN source = 'src5' THEN TIMESTAMP '2024-03-01 00:00:00' WHEN source = 'src3' THEN TIMESTAMP '2024-02-01 00:00:00' END AS rolled_back_at FROM documents",
)
def ver_rollback(spark, sf):
    """The registry after a version was promoted and the one before it brought back."""
    none = F.lit(None).cast("timestamp_ntz")
    rows = table(spark, sf, "documents").select(F.col("source").alias("version")).distinct().withColumns({"is_current": F.col("version") == "src3", "activated_at": none, "rolled_back_at": none})
    return V.with_current(V.with_current(rows, "src5", "2024-02-01 00:00:00"), "src3", "2024-03-01 00:00:00").select("version", "is_current", "activated_at", "rolled_back_at")


@query(
    "ctl_prompt_activate",
    "SELECT kind, version, char_count, version = CASE WHEN kind = 'en' THEN 3 ELSE last END AS active FROM (SELECT *, max(version) OVER (PARTITION BY kind) AS last FROM (SELECT lang AS kind, row_number() OVER (PARTITION BY lang ORDER BY source) AS version, char_count FROM (SELECT lang, source, max(length(text))::INT AS char_count FROM documents GROUP BY 1, 2) UNION ALL SELECT 'new', 1, 5))",
)
def ctl_prompt_activate(spark, sf):
    """Templates by kind and version: a new kind's first version is active at once, and activating one version ends another in the same step."""
    order = Window.partitionBy("kind")
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("kind"), "source").agg(F.max(F.length("text")).alias("char_count"))
    rows = rows.withColumn("version", F.row_number().over(order.orderBy("source"))).drop("source")
    rows = rows.unionByName(spark.createDataFrame([("new", 5, 1)], "kind string, char_count int, version int"))
    chosen = F.when(F.col("kind") == "en", F.lit(3)).otherwise(F.max("version").over(order))
    return rows.select("kind", "version", "char_count", (F.col("version") == chosen).alias("active"))


@query(
    "cat_manifest",
    "SELECT coalesce(p_brand, 'total') AS brand, count(*) AS rows, count(*) FILTER (WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 = 0) AS price_changed, count(*) FILTER (WHERE p_partkey % 5 = 0 AND p_partkey % 2 = 0) AS added FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0 GROUP BY ROLLUP (p_brand)",
)
def cat_manifest(spark, sf):
    """What a version of a price list changed, by brand and in all."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    new = parts.where("p_partkey % 2 = 0").withColumn("price", F.when(F.col("p_partkey") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    rows = merged(parts.where("p_partkey % 5 <> 0"), new, ["p_partkey", "p_brand"], "price")
    rolled = rows.rollup("p_brand").agg(F.count("*").alias("rows"), F.count_if(F.col("change") == "updated").alias("price_changed"), F.count_if(F.col("change") == "added").alias("added"))
    return rolled.select(F.coalesce("p_brand", F.lit("total")).alias("brand"), "rows", "price_changed", "added")


@query(
    "web_url_parts",
    r"SELECT page_id, lower(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, 'Bảo hành ' || page_id AS label FROM (SELECT page_id, url AS u FROM pages)",
)
def web_url_parts(spark, sf):
    """Hosts, and labels read from the last part of a path."""
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/B%E1%BA%A3o-h%C3%A0nh-"), "page_id", F.lit(".html?x=1"))
    last = F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"([^/]*?)(\.[a-z]+)?$", 1)
    label = F.regexp_replace(F.url_decode(last), "[-_]+", " ")
    return table(spark, sf, "pages").select("page_id", F.lower(F.parse_url(url, F.lit("HOST"))).alias("host"), label.alias("label"))


@query(
    "ev_history_texts",
    "SELECT conv_id, turn, md5(coalesce(string_agg(role || '=' || text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS digest FROM conversations",
)
def ev_history_texts(spark, sf):
    """The history that each turn of an evaluated conversation is asked with."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    history = F.collect_list(F.concat("role", F.lit("="), "text")).over(before)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.array_join(history, "|")).alias("digest"))
