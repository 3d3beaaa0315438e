"""Queries over texts and pages: tokens, slugs, lines, sections, chunks, version differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import corpus as C
from ..operators.runs import numbered
from .base import query, table

STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{X.TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"
STRIP = f"translate(lower(%s), '{X.ACCENTED}đ', '{X.PLAIN}d')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("txt_tokenize", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def txt_tokenize(spark, sf):
    rows = docs(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(" + STRIP % "%s" + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'section')"


@query(
    "txt_slug_hash",
    f"""SELECT doc_id, {SLUG % "substr(text, 1, 60)"} AS slug, source || ':general:' || lang || ':' || {SLUG % "lang || ' ' || source"} || ':' || doc_id AS stable_id,
  sha1(text || chr(31) || lang) AS content_hash, 'doc:' || substr(sha1(lang || '|' || source), 1, 16) AS cache_key, substr(sha256(text), 1, 12) AS prompt_hash FROM documents""",
)
def txt_slug_hash(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        X.slug(F.substring("text", 1, 60)).alias("slug"),
        X.stable_id(F.col("source"), F.lit(None).cast("string"), F.col("lang"), F.array(F.lit("top"), "lang", "source"), F.col("doc_id")).alias("stable_id"),
        X.content_hash(F.col("text"), F.col("lang")).alias("content_hash"),
        X.cache_key("doc", F.col("lang"), F.col("source")).alias("cache_key"),
        F.substring(F.sha2("text", 256), 1, 12).alias("prompt_hash"),
    )


@query("txt_strip_marks", f"SELECT doc_id, md5({STRIP % 'text'}) AS digest FROM documents")
def txt_strip_marks(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.strip_marks(F.col("text"))).alias("digest"))


@query(
    "txt_uuid5",
    f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END]
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, sha1(unhex('{X.NAMESPACE}') || encode('doc:' || doc_id)) AS h FROM documents)""",
)
def txt_uuid5(spark, sf):
    return docs(spark, sf).select("doc_id", X.uuid5(F.concat(F.lit("doc:"), F.col("doc_id"))).alias("point_id"))


@query("txt_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, substr(text, 1, 500) AS head FROM documents")
def txt_token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"), F.substring("text", 1, 500).alias("head"))


@query("txt_money_flag", f"SELECT doc_id, regexp_matches(text, '(?i){X.MONEY}') AS has_money FROM documents")
def txt_money_flag(spark, sf):
    return docs(spark, sf).select("doc_id", X.has_money(F.col("text")).alias("has_money"))


LINES = "l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query(
    "txt_line_dedup",
    f"""WITH {LINES}, n AS (SELECT *, lower(trim(line)) AS norm FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS rep, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS nth FROM n)
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM c WHERE norm = '' OR rep < 3 OR nth = 1 GROUP BY doc_id""",
)
def txt_line_dedup(spark, sf):
    kept = docs(spark, sf).select("doc_id", C.repeated_lines_once(F.col("text")).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("long").alias("kept"), F.md5(F.array_join("kept", "\n")).alias("digest"))


NOISE = "|".join(X.NOISE).replace("'", "''")


@query(
    "txt_noise_lines",
    f"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND regexp_matches(trim(line), '(?i){NOISE}')) AS noise FROM l GROUP BY doc_id",
)
def txt_noise_lines(spark, sf):
    rows = docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.filter(F.transform(C.lines(F.col("text")), lambda x: X.trimmed(x)), lambda x: x != "").alias("l"))
    noise = F.filter("l", lambda x: X.is_boilerplate(x))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(noise).cast("long").alias("noise"))


CLEAN = "x"
for _pattern, _to in X.CLEANED:
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern}', '{_to}', 'g')".replace("$1", "\\1")
CLEAN = f"trim({CLEAN})"


@query(
    "txt_clean_lines",
    f"""SELECT doc_id, len(l)::INT AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches({CLEAN}, '(?i){NOISE}') THEN '' ELSE {CLEAN} END), lambda x: x <> '') AS l FROM documents)""",
)
def txt_clean_lines(spark, sf):
    kept = F.filter(F.transform(C.lines(F.col("text")), X.bare_line), lambda x: (x != "") & ~X.is_boilerplate(x))
    return docs(spark, sf).select("doc_id", kept.alias("kept")).select("doc_id", F.size("kept").alias("n_lines"), F.md5(F.array_join("kept", "\n")).alias("digest"))


@query(
    "txt_type_detect",
    r"""SELECT CASE WHEN length(text) - length(replace(text, '|', '')) >= 4 THEN 'table'
  WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*([-*•]|\d+[.)])\s'))) = len(ls) THEN 'list'
  WHEN regexp_matches(text, '\?\s*\n') THEN 'qa_pair' ELSE 'prose' END AS kind, count(*) AS n
FROM (SELECT text, list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents) GROUP BY 1""",
)
def txt_type_detect(spark, sf):
    return docs(spark, sf).groupBy(X.text_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("txt_ids_seq", "SELECT doc_id, seq FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS seq FROM documents) WHERE length(text) > 500")
def txt_ids_seq(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", "lang", (F.length("text") > 500).alias("long"))
    return numbered(rows, ["source", "lang"], "doc_id").where("long").select("doc_id", "seq")


@query(
    "txt_validate",
    "SELECT ok AS valid, count(*) AS n FROM (SELECT trim(text) <> '' AND lang IS NOT NULL AND doc_id % 13 <> 0 AND (doc_id % 120) / 100.0 <= 1 AND lang IN ('en', 'fr', 'de') AS ok FROM documents) GROUP BY 1",
)
def txt_validate(spark, sf):
    tags = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    ok = C.valid_chunk(F.col("text"), F.col("lang"), tags, (F.col("doc_id") % 120) / 100.0, ("en", "fr", "de"), F.col("lang"))
    return docs(spark, sf).groupBy(ok.alias("valid")).agg(F.count("*").alias("n"))


OLD = "o AS (SELECT doc_id, source, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 0)"
NEW = "n AS (SELECT doc_id, source, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1)"


@query(
    "txt_version_diff",
    f"WITH {OLD}, {NEW} SELECT coalesce(n.source, o.source) AS source, count(*) FILTER (WHERE o.h IS NULL) AS added, count(*) FILTER (WHERE n.h IS NULL) AS removed, count(*) FILTER (WHERE o.h <> n.h) AS modified FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1",
)
def txt_version_diff(spark, sf):
    d = docs(spark, sf)
    old = d.where("doc_id % 10 <> 0").select("doc_id", "source", F.sha1("text").alias("hash"))
    new = d.where("doc_id % 10 <> 1").select("doc_id", "source", F.sha1(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return C.version_diff(old, new, "doc_id", "source")


@query(
    "txt_prev_version",
    "SELECT v, (SELECT arg_max(o.v, (o.at, o.v)) FROM s o WHERE o.v <> s.v) AS prev FROM (SELECT source AS v, max(doc_id) AS at FROM documents GROUP BY source) s".replace("FROM s o", "FROM (SELECT source AS v, max(doc_id) AS at FROM documents GROUP BY source) o"),
)
def txt_prev_version(spark, sf):
    # The latest other version: the second latest for the latest one, the latest for every other.
    versions = docs(spark, sf).groupBy(F.col("source").alias("v")).agg(F.max("doc_id").alias("at"))
    top = versions.orderBy(F.desc("at"), F.desc("v")).limit(2).agg(F.max_by("v", F.struct("at", "v")).alias("first"), F.min_by("v", F.struct("at", "v")).alias("second"))
    return versions.join(F.broadcast(top)).select("v", F.when(F.col("v") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("prev"))


@query(
    "txt_text_dedup",
    r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS nth FROM (SELECT doc_id, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS norm FROM documents) WHERE norm <> '') WHERE nth = 1",
)
def txt_text_dedup(spark, sf):
    return C.first_by_text(docs(spark, sf).select("doc_id", "text"), ["doc_id"]).select("doc_id")


SENTENCES = "l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS p FROM documents))"


def sentence_lines():
    return F.replace(F.col("text"), F.lit(". "), F.lit("\n"))


HEADING = r"^[^.!?|]{1,60}$"


@query(
    "txt_sections",
    f"""WITH {SENTENCES}, h AS (SELECT *, regexp_matches(trim(line), '{HEADING}') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER w AS section, last_value(CASE WHEN head THEN trim(line) END IGNORE NULLS) OVER w AS title FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section::BIGINT AS section, max(title) AS title, count(*) AS n_lines FROM s GROUP BY doc_id, section""",
)
def txt_sections(spark, sf):
    return docs(spark, sf).select("doc_id", F.inline(C.sections(sentence_lines(), lambda x: F.btrim(x).rlike(HEADING))))


@query(
    "txt_short_merge",
    f"""WITH {SENTENCES}, s AS (SELECT *, length(trim(line)) < 25 AND NOT regexp_matches(line, '[.:;|-]') AND trim(line) <> '' AS short FROM l),
n AS (SELECT *, (NOT short OR NOT coalesce(lag(short) OVER (PARTITION BY doc_id ORDER BY pos), false))::INT AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT doc_id, min(pos)::INT AS pos, string_agg(trim(line), ' ' ORDER BY pos) AS paragraph FROM i GROUP BY doc_id, island HAVING count(*) > 1""",
)
def txt_short_merge(spark, sf):
    return docs(spark, sf).select("doc_id", F.inline(C.merged_fragments(sentence_lines()))).where("members > 1").select("doc_id", "pos", "paragraph")


@query(
    "txt_pack_sentences",
    r"""WITH RECURSIVE s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, x FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM
  (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS p FROM documents))),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, '' AS buf, '' AS last, NULL::VARCHAR AS done FROM s
  UNION ALL SELECT doc_id, i, CASE WHEN packed THEN CASE WHEN last <> '' AND length(last || ' ' || x) <= 800 THEN last || ' ' || x ELSE x END WHEN buf = '' THEN x ELSE buf || ' ' || x END, x, CASE WHEN packed THEN buf END
  FROM (SELECT r.doc_id, s.i, s.x, r.buf, r.last, r.buf <> '' AND length(r.buf || ' ' || s.x) > 800 AS packed FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)),
c AS (SELECT doc_id, i, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(i) + 1, arg_max(buf, i) FROM r GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS piece, chunk FROM c WHERE length(trim(chunk)) >= 20""",
)
def txt_pack_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.packed_sentences(F.col("text"))).alias("piece", "chunk"))


@query(
    "txt_money_paras",
    f"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: NOT (regexp_matches(p, '(?i){X.PRICE_WORD}') AND regexp_matches(p, '(?i){X.MONEY}'))), chr(10) || chr(10))) AS digest FROM documents""",
)
def txt_money_paras(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.without_money_paragraphs(F.col("text"))).alias("digest"))


@query(
    "txt_chunk_filters",
    r"""SELECT count(*) FILTER (WHERE junk) AS junk, count(*) FILTER (WHERE offmodel) AS off_model, count(*) FILTER (WHERE spec) AS spec_table FROM (
  SELECT lower(split_part(text, ' ', 1)) IN ('menu', 'navigation', 'footer', 'contact') OR regexp_matches(text, '(?i)^\s*(cookie|privacy policy|terms of use)') OR (len(nav) >= 2 AND 2 * len(nav) >= len(ls)) AS junk,
    (contains(lower(text), 'idiot') OR contains(lower(text), 'scum')) AND NOT contains(lower(text), source) AS offmodel,
    length(text) - length(replace(text, '|', '')) >= 4 AND contains(lower(text), 'the') AS spec
  FROM (SELECT *, list_filter(ls, lambda x: length(trim(x)) < 20 AND NOT regexp_matches(x, '[.!?:]')) AS nav FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)))""",
)
def txt_chunk_filters(spark, sf):
    text, low = F.col("text"), F.lower("text")
    junk = C.is_junk(F.split_part("text", F.lit(" "), F.lit(1)), text)
    rivals = F.exists(F.array(F.lit("idiot"), F.lit("scum")), lambda b: F.contains(F.lower(F.col("text")), b))
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return docs(spark, sf).agg(F.count_if(junk).alias("junk"), F.count_if(rivals & ~F.contains(low, F.col("source"))).alias("off_model"), F.count_if((pipes >= 4) & F.contains(low, F.lit("the"))).alias("spec_table"))


HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
PATH = r"lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1))"


@query(
    "web_url_route",
    f"""SELECT page_id, host, CASE WHEN host = '' THEN 'general' WHEN ends_with(path, '.pdf') THEN 'manual' WHEN regexp_matches(path, '/(blog|news|post)') THEN 'policy' WHEN ends_with(host, '.org') THEN 'policy' ELSE 'general' END AS collection,
  CASE WHEN host = '' THEN 0.3 WHEN ends_with(path, '.pdf') THEN 0.9 WHEN regexp_matches(path, '/(blog|news|post)') THEN 0.7 WHEN ends_with(host, '.org') THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
FROM (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages)""",
)
def web_url_route(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), C.routed(F.col("url")).alias("r"))
    return rows.select("page_id", "host", "r.collection", "r.confidence")


@query("web_host_counts", f"SELECT {HOST} AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def web_host_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(F.lower(F.parse_url("url", F.lit("HOST"))).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("web_html_to_md")
def web_html_to_md(spark, sf):
    return H.pages_to_chunks(table(spark, sf, "pages").select("page_id", "html"))
