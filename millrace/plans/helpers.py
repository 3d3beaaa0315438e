"""Queries over the smaller helpers: query text, links, numbers, contexts, registries, log records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .base import query, table
from .telemetry import M, facts


NORMAL = r"trim(regexp_replace(regexp_replace(lower('MK-' || item_id || ' ' || text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("txt_normalize_query", rf"SELECT item_id, regexp_replace({NORMAL}, '\bmk[\s_-]*(\d+)', 'mk \1', 'g') AS q FROM benchmark")
def txt_normalize_query(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.normalized_query(F.concat(F.lit("MK-"), "item_id", F.lit(" "), "text")).alias("q"))


WORDS = "list_filter(string_split(l, ' '), lambda w: w <> '')"
JOINED = f"CASE WHEN len(list_filter({WORDS}, lambda w: length(w) = 1)) >= 3 AND 2 * len(list_filter({WORDS}, lambda w: length(w) = 1)) > len({WORDS}) THEN array_to_string({WORDS}, '') ELSE l END"


@query("txt_joined_letters", f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: {JOINED}), chr(10))) AS digest FROM documents")
def txt_joined_letters(spark, sf):
    lines = F.transform(F.split("text", "\n"), X.joined_letters)
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


@query("txt_urls", r"SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\s)>\]]+')))::INT AS urls FROM pages")
def txt_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(X.urls(F.col("html"))).alias("urls"))


@query("txt_numbers", r"SELECT doc_id, len(n)::INT AS n, list_reduce(list_prepend(0.0::DOUBLE, n), lambda a, b: a + b) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')::DOUBLE) AS n FROM documents)")
def txt_numbers(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", X.numbers(F.col("text")).alias("a"))
    return rows.select("doc_id", F.size("a").alias("n"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("txt_unwrap_json", "SELECT event_id, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::INT AS k FROM events")
def txt_unwrap_json(spark, sf):
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.from_json(X.unwrapped_json(fenced), "k int").getField("k").alias("k"))


@query("qry_context_format", "SELECT p_brand, count(*) AS n, string_agg(p_name || ': ' || format('{:,}', floor(p_retailprice)::BIGINT) || ' VND', chr(10) ORDER BY p_partkey) AS context FROM part GROUP BY p_brand")
def qry_context_format(spark, sf):
    line = F.concat("p_name", F.lit(": "), F.format_number(F.floor("p_retailprice"), 0), F.lit(" VND"))
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    return rows.select("p_brand", "n", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


@query("qry_source_links", "SELECT source, lang, doc_id AS first_doc FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id) AS n FROM documents) WHERE n = 1")
def qry_source_links(spark, sf):
    priority = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    rows = table(spark, sf, "documents").groupBy("source").agg(F.min_by(F.struct("lang", "doc_id"), F.struct(priority, "doc_id")).alias("best"))
    return rows.select("source", "best.lang", F.col("best.doc_id").alias("first_doc"))


@query("qry_lookup_colors", "SELECT l_returnflag AS color, list_sort(list_distinct(list(l_linestatus))) AS interiors, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE upper(p_brand) = 'BRAND#3') GROUP BY 1")
def qry_lookup_colors(spark, sf):
    chosen = table(spark, sf, "part").where(F.upper("p_brand") == "BRAND#3").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").join(chosen, "l_partkey", "left_semi")
    return rows.groupBy(F.col("l_returnflag").alias("color")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("interiors"), F.count("*").alias("n"))


@query("qry_followup", "SELECT conv_id, bool_or(contains(lower(text), 'la ') OR contains(lower(text), 'the ')) AS follows FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1 GROUP BY conv_id")
def qry_followup(spark, sf):
    last = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    phrases = F.array(F.lit("la "), F.lit("the "))
    return last.select("conv_id", F.exists(phrases, lambda p: F.contains(F.lower(F.col("t")), p)).alias("follows"))


@query("qry_names_mentioned", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}'))) AS names FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents)")
def qry_names_mentioned(spark, sf):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(spark, sf, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit("([A-Z][a-z]{6,})"), F.lit(1)))).alias("names"))


@query("ctl_prompts", "SELECT lang AS kind, source AS version, max(length(text))::INT AS char_count, source = max(source) OVER (PARTITION BY lang) AS active FROM documents GROUP BY lang, source")
def ctl_prompts(spark, sf):
    """A registry of templates with one active version of each kind."""
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("kind"), F.col("source").alias("version")).agg(F.max(F.length("text")).alias("char_count"))
    return rows.withColumn("active", F.col("version") == F.max("version").over(Window.partitionBy("kind")))


@query("ctl_cache_counters", M + "SELECT coalesce(intent, 'general') AS prefix, count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses FROM m GROUP BY 1")
def ctl_cache_counters(spark, sf):
    return facts(spark, sf).groupBy(F.coalesce("intent", F.lit("general")).alias("prefix")).agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))


@query("tel_log_records", M + "SELECT request_id, '{\"request_id\":\"' || request_id || '\",\"status\":' || status_code || '}' AS record FROM m WHERE status_code >= 500")
def tel_log_records(spark, sf):
    rows = facts(spark, sf).where("status_code >= 500")
    return rows.select("request_id", F.to_json(F.struct("request_id", F.col("status_code").alias("status"))).alias("record"))


@query("ev_url_verdict", "SELECT page_id, CASE WHEN len(u) > 0 AND len(list_filter(u, lambda x: starts_with(x, 'https'))) = len(u) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT page_id, list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[^\\s)>\\]]+')) AS u FROM pages)")
def ev_url_verdict(spark, sf):
    found = table(spark, sf, "pages").select("page_id", X.urls(F.concat_ws(" ", "url", "html")).alias("u"))
    ok = (F.size("u") > 0) & F.forall("u", lambda x: x.startswith("https"))
    return found.select("page_id", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


@query("ver_snapshot_id", "SELECT coalesce(NULL, (SELECT source || '@' || max(doc_id) FROM documents WHERE source = 'src3' GROUP BY source), 'unknown') AS snapshot")
def ver_snapshot_id(spark, sf):
    """The configured id, else the current version with its date, else unknown."""
    registry = table(spark, sf, "documents").where("source = 'src3'").agg(F.max("source").alias("v"), F.max("doc_id").alias("at"))
    return registry.select(F.coalesce(F.lit(None).cast("string"), F.concat("v", F.lit("@"), "at"), F.lit("unknown")).alias("snapshot"))

