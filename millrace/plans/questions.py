"""Queries on what questions ask for, which sources answer them, and what brochures and scans leave in a text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as Q
from ..functions import rules
from ..functions import tables as T
from ..functions.text import estimated_tokens
from ..operators import evidence
from .base import query, table
from .corpus import STRIP

#: Questions for the tables' texts, which have few of these words.
ASKED = ("cửa sổ trời", "túi khí bao nhiêu", "công suất", "quãng đường", "sạc nhanh", "tăng tốc", "chiều dài", "wheelbase", "số chỗ", "màn hình", "điều hòa", "cốp", "mâm", "giá", "so sánh", "tính năng", "weather", "an toàn và loa", "camera 360", "pin")


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


ASK = f"({sql_list(ASKED)})[{{0}} % {len(ASKED)} + 1]"


def ask(key):
    return F.element_at(F.array(*map(F.lit, ASKED)), (F.col(key) % len(ASKED) + 1).cast("int"))


TOPICS = "[" + ", ".join(f"{{'w': '{w}', 'c': {sql_list(c)}::VARCHAR[]}}" for w, c in T.TOPIC_CATEGORIES) + "]"
CATEGORIES = f"""(SELECT item_id, CASE WHEN len(h) > 0 AND len(list_filter(h, lambda x: len(x.c) = 0)) = 0 THEN list_sort(list_distinct(flatten(list_transform(h, lambda x: x.c)))) END AS cats
  FROM (SELECT item_id, list_filter({TOPICS}, lambda x: contains(lower(q), x.w)) AS h FROM (SELECT item_id, {ASK.format('item_id')} || ' ' || text AS q FROM benchmark)))"""
KINDS = ("battery", "powertrain", "dimension", "safety", "adas", "interior", "exterior", "price", "infotainment")


def questions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(ask("item_id"), F.lit(" "), "text").alias("q"))


@query("qry_question_categories", f"SELECT item_id, cats FROM {CATEGORIES}")
def qry_question_categories(spark, sf):
    return questions(spark, sf).select("item_id", Q.relevant_categories(F.col("q")).alias("cats"))


@query(
    "qry_context_prune",
    f"""WITH s AS (SELECT ({sql_list(KINDS)})[p_partkey % {len(KINDS)} + 1] AS category, p_partkey FROM part), n AS (SELECT category, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM s GROUP BY 1)
SELECT item_id, sum(n)::BIGINT AS kept, sum(keys)::BIGINT AS keys, any_value(cats) IS NULL AS whole FROM {CATEGORIES} JOIN n ON cats IS NULL OR list_contains(cats, category) GROUP BY item_id""",
)
def qry_context_prune(spark, sf):
    """How many rows of a catalogue stay in each question's context. Rows are added up by category before they meet questions."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    rows = table(spark, sf, "part").groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
    asked = qry_question_categories(spark, sf).withColumn("whole", F.col("cats").isNull())
    wanted = asked.select("item_id", "whole", F.explode(F.coalesce("cats", F.array(*map(F.lit, KINDS)))).alias("category"))
    return wanted.join(rows, "category").groupBy("item_id", "whole").agg(F.sum("n").alias("kept"), F.sum("keys").alias("keys"))


SPEC_CASES = " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{k}'" for k, p in T.SPEC_KEYS)


@query("qry_spec_key", f"SELECT item_id, CASE {SPEC_CASES} END AS spec_key FROM (SELECT item_id, {ASK.format('item_id')} || ' ' || text AS q FROM benchmark)")
def qry_spec_key(spark, sf):
    return questions(spark, sf).select("item_id", rules.first_match(F.col("q"), T.SPEC_KEYS, None).alias("spec_key"))


WANTED = "the price of the ton and xe"


@query(
    "qry_citations_valid",
    f"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS url, text, (doc_id % 100) / 100.0 AS score,
  list_filter(regexp_extract_all(lower(text), '[a-zà-ỹ0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_WORDS)})) AS t FROM documents)
WHERE url <> '' AND (text = '' OR score >= 0.3 OR len(list_intersect(t, {sql_list(WANTED.split())})) > 0)""",
)
def qry_citations_valid(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("url"), ((F.col("doc_id") % 100) / 100.0).alias("score"))
    return rows.where(Q.valid_citation(F.col("url"), F.col("text"), F.col("score"), F.array(*map(F.lit, WANTED.split())))).select("doc_id")


@query(
    "qry_page_list",
    "SELECT source, array_to_string(list_transform(list_sort(list_distinct(list({'n': CASE WHEN regexp_full_match(p, '[0-9]+') THEN p::INT ELSE 0 END, 'p': p}))), lambda x: x.p), ', ') AS pages FROM (SELECT source, CASE WHEN doc_id % 50 = 3 THEN 'iv' ELSE (doc_id % 50)::VARCHAR END AS p FROM documents) GROUP BY source",
)
def qry_page_list(spark, sf):
    page = F.when(F.col("doc_id") % 50 == 3, "iv").otherwise((F.col("doc_id") % 50).cast("string"))
    rows = table(spark, sf, "documents").groupBy("source").agg(F.collect_set(page).alias("p"))
    return rows.select("source", F.array_join(Q.sorted_pages(F.col("p")), ", ").alias("pages"))


GROUPS = ", ".join(f"('{g}', {sql_list(phrases)})" for g, phrases in T.SPEC_WORDS)


@query(
    "qry_key_words",
    f"""WITH g AS (SELECT DISTINCT grp, unnest(flatten(list_transform(phrases, lambda p: regexp_extract_all(p, '[a-zà-ỹ0-9]+')))) AS w FROM (VALUES {GROUPS}) x(grp, phrases)),
k AS (SELECT DISTINCT v.w AS word, k.w AS key FROM g k JOIN g v USING (grp) WHERE regexp_full_match(k.w, '[a-z0-9]+') AND NOT regexp_full_match(v.w, '[a-z0-9]+')),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower({ASK.format('item_id')} || ' ' || text), '[a-zà-ỹ0-9]+'))) AS word FROM benchmark)
SELECT item_id, list_sort(list(DISTINCT key)) AS keys FROM q JOIN k USING (word) GROUP BY item_id""",
)
def qry_key_words(spark, sf):
    """The plain keys whose group of words has one of each question's local words."""
    groups = evidence.word_groups(spark)
    plain = F.col("token").rlike("^[a-z0-9]+$")
    keys = groups.where(plain).withColumnRenamed("token", "key").join(groups.where(~plain), "group").select(F.col("token").alias("word"), "key").distinct()
    words = questions(spark, sf).select("item_id", F.explode(evidence.words(F.col("q"))).alias("word"))
    return words.join(F.broadcast(keys), "word").groupBy("item_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


@query(
    "qry_guards",
    "SELECT conv_id, turn, greatest(1, length(text) // 4) > 60 AS too_long, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT > 400 AS history_full, regexp_full_match(id, '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}') AS known_id FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE '0f8fad5b-d9cb-469f-a165-70867728950e' END AS id FROM conversations)",
)
def qry_guards(spark, sf):
    """Requests that are refused: long messages, long histories, ids that aren't UUIDs."""
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    n = estimated_tokens(F.col("text"))
    uid = F.when(F.col("conv_id") % 3 == 0, "x").otherwise("0f8fad5b-d9cb-469f-a165-70867728950e")
    return table(spark, sf, "conversations").select("conv_id", "turn", (n > 60).alias("too_long"), (F.sum(n).over(so_far) > 400).alias("history_full"), uid.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$").alias("known_id"))


@query(
    "qry_messages",
    """SELECT conv_id, len(m)::INT AS n, md5(array_to_string(m, chr(10))) AS digest FROM (SELECT conv_id, list_prepend('system: be brief', list(role || ': ' || substr(text, 1, 100) ORDER BY turn)) AS m FROM conversations
WHERE role IN ('user', 'assistant') GROUP BY conv_id)""",
)
def qry_messages(spark, sf):
    """The messages of each conversation for a reply: instructions, history, the last question, each cut to its room."""
    said = F.concat("role", F.lit(": "), F.substring("text", 1, 100))
    rows = table(spark, sf, "conversations").where("role IN ('user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("h"))
    rows = rows.withColumn("m", F.array_prepend(F.transform("h", lambda x: x["said"]), F.lit("system: be brief")))
    return rows.select("conv_id", F.size("m").alias("n"), F.md5(F.array_join("m", "\n")).alias("digest"))


LABEL = "'  ' || p_name || '  (É) & ' || p_brand || ' : '"
NORM = f"trim(trim(regexp_replace({STRIP % LABEL}, '\\s+', ' ', 'g')), ':|-–— ' || chr(9))"


@query("cat_label_norm", f"SELECT p_partkey, {NORM} AS norm, trim(regexp_replace(regexp_replace({NORM}, '[,:;()/&\\-–—]+', ' ', 'g'), '\\s+', ' ', 'g')) AS strict FROM part")
def cat_label_norm(spark, sf):
    label = F.concat(F.lit("  "), "p_name", F.lit("  (É) & "), "p_brand", F.lit(" : "))
    return table(spark, sf, "part").select("p_partkey", Q.label_norm(label).alias("norm"), Q.label_norm_strict(label).alias("strict"))


@query("cat_plain_dimensions", "SELECT p_partkey, 'size 4' || lpad(p_size::VARCHAR, 3, '0') || ' × 1' || lpad((p_size * 3)::VARCHAR, 3, '0') || ' × 1580 mm, 12 x 3 and 2500 × 1' || lpad(p_size::VARCHAR, 3, '0') || '.' AS t FROM part")
def cat_plain_dimensions(spark, sf):
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    size = F.col("p_size")
    text = F.concat(F.lit("size 4."), three(size), F.lit(" x 1,"), three(size * 3), F.lit("X1.580 mm, 12 x 3 and 2.500 × 1."), three(size), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", Q.plain_dimensions(text).alias("t"))


REPAIRS = (("ation", "ATION"), ("tion", "tíon"), ("the", "thế"), ("ther", "thểr"), ("ou", "0u"), ("tion", "never"))


@query("txt_repair", "SELECT doc_id, md5(" + "replace(" * 5 + f"replace(replace(translate(text || ' Оа Æ æ', '{T.LOOKALIKES[0]}', '{T.LOOKALIKES[1]}'), 'Æ', 'AE'), 'æ', 'ae')" + ", 'ation', 'ATION'), 'tion', 'tíon'), 'ther', 'thểr'), 'the', 'thế'), 'ou', '0u')) AS digest FROM documents")
def txt_repair(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(Q.repaired(F.concat("text", F.lit(" Оа Æ æ")), REPAIRS)).alias("digest"))


@query("cat_edition_header", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS edition FROM part")
def cat_edition_header(spark, sf):
    header = F.concat(F.lit("MK "), "p_size", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(" - "), "p_type")))
    return table(spark, sf, "part").select("p_partkey", Q.edition_of(header, "mk").alias("edition"))


ADDED = "\n12\n61\n| a | b |\nHình ảnh mang tính chất minh họa\nThông số kỹ thuật chung\n(*) note\n left | over \n|---|\n*Phiên bản cao\nThông tin: thông số kỹ thuật có thể thay đổi\nMK 6 ECO\nTính năng mk 6 plus có\nend"
LEGAL = "[" + ", ".join(f"'{p}'" for p in T.DISCLAIMERS) + "]"


@query(
    "txt_brochure_prose",
    f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(l, lambda x: trim(x) = '' OR NOT (starts_with(trim(x), '|') OR len(list_filter({LEGAL}, lambda p: contains({STRIP % 'x'}, p))) > 0 OR (contains({STRIP % 'x'}, '{T.DISCLAIMER_PAIR[0]}') AND contains({STRIP % 'x'}, '{T.DISCLAIMER_PAIR[1]}'))
  OR (regexp_full_match(trim(x), '[0-9]{{1,2}}') AND try_cast(trim(x) AS INT) <= 60) OR regexp_matches(trim(x), '(?i){T.FOOTNOTES}') OR regexp_matches(trim(x), '(?i){T.TABLE_HEADINGS}') OR regexp_matches(trim(x), '(?i){T.HEADING_RESIDUE}') OR trim(x) = 'MK 6 ECO' OR (contains(x, '|') AND trim(replace(x, '|', '')) = ''))),
  lambda x: CASE WHEN contains(x, '|') THEN trim(replace(trim(x), '|', '')) ELSE x END), chr(10))) AS digest FROM (SELECT doc_id, string_split(text || '{ADDED}', chr(10)) AS l FROM documents)""",
)
def txt_brochure_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(Q.brochure_prose(F.concat("text", F.lit(ADDED)), ("MK 6 ECO",))).alias("digest"))


@query("web_js_rows", "SELECT page_id, unnest([page_id, page_id + 1]) AS id, unnest([100.5, 7.0])::DOUBLE AS price FROM pages")
def web_js_rows(spark, sf):
    script = F.concat(F.lit('<script>var other = [1]; var cars = [{"id": '), "page_id", F.lit(', "price": 100.5}, {"id": '), F.col("page_id") + 1, F.lit(', "price": 7, "x": [2]}] ;</script>'))
    rows = table(spark, sf, "pages").select("page_id", F.inline(Q.js_rows(F.concat("html", script), "cars", "id: bigint, price: double")))
    return rows.select("page_id", "id", "price")


MODELS = (("mk2", "M2"), ("mk206", "M6"), ("mk6", "M6"), ("mk8", "M8"), ("mk8thenew", "M8N"), ("mpv7", "MPV7"))


@query(
    "web_model_from_path",
    "SELECT page_id, (['M6', 'M8N', 'M8', NULL, 'MPV7'])[page_id % 5 + 1] AS model FROM pages",
)
def web_model_from_path(spark, sf):
    """The model that the last part of a path names; the longest key wins."""
    names = F.array(*map(F.lit, ("Mk 2-06_manual.pdf", "mk8 The New.csv", "MK-8.txt", "about.html", "x_MPV 7.csv")))
    path = F.concat(F.lit("/files/mk9/"), F.element_at(names, (F.col("page_id") % 5 + 1).cast("int")))
    stem = F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)), "[^a-z0-9]", "")
    return table(spark, sf, "pages").select("page_id", rules.longest_key(stem, MODELS, None).alias("model"))


SAID = ("Xin chào bạn!", "cảm ơn nhiều", "bạn là ai", "đặt lịch lái thử", "giá xe bao nhiêu tiền", "so sánh hai xe", "xe nào có hud", "xe có camera lùi không?", "danh sách xe", "có mấy phiên bản", "màu gì", "bảo hành pin", "thời tiết hôm nay", "túi khí", "tell me more", "chào bạn, giá xe", "hệ thống treo", "chống trộm", "tiện nghi", "âm thanh", "giữ làn", "động cơ")
SAY = f"({sql_list(SAID)})[({{0}}) % {len(SAID)} + 1]"
SPEC_GROUP = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN {'NULL' if k is None else repr(k)}" for k, p in T.SPEC_GROUPS) + " END"
WANTS = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(q)), '{p}', 's') THEN '{k}'" for k, p in T.QUESTION_INTENTS) + f" WHEN topic <> 'general' THEN 'spec_query' WHEN regexp_matches(lower(q), '{T.OUT_OF_SCOPE}', 's') THEN 'out_of_scope' ELSE 'general' END"


def say(number):
    return F.element_at(F.array(*map(F.lit, SAID)), (number % len(SAID) + 1).cast("int"))


@query("qry_question_intent", f"SELECT conv_id, turn, {WANTS} AS wants, {SPEC_GROUP} AS spec_group FROM (SELECT conv_id, turn, {SAY.format('conv_id + turn')} || CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || text END AS q, CASE WHEN turn % 2 = 0 THEN 'battery' ELSE 'general' END AS topic FROM conversations)")
def qry_question_intent(spark, sf):
    q = F.concat(say(F.col("conv_id") + F.col("turn")), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "text")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"), F.when(F.col("turn") % 2 == 0, "battery").otherwise("general").alias("topic"))
    return rows.select("conv_id", "turn", Q.question_intent(F.col("q"), F.col("topic")).alias("wants"), rules.first_match(F.col("q"), T.SPEC_GROUPS, None).alias("spec_group"))


RULES = ("Không chọn Eco hoặc Plus mặc định", "Không trộn NEDC/WLTP", "Không dùng kiến thức nền", "Không đoán", "Không so sánh hai xe", "Không khuyên", "Không bịa", "Không chẩn đoán")
ANSWERS = ("bản eco tốt", "chọn plus", "đi 400 km theo NEDC, 380 theo wltp", "bạn nên kiểm tra phanh", "khác nhau nhiều, nên mua", "eco")


def sql_broken(name, groups, has, lacks, bare):
    asked = " AND ".join("(" + " OR ".join(f"contains(lower(r), '{w}')" for w in words) + ")" for words in groups)
    bad = "evidence = 0" if bare else f"regexp_matches(lower(answer), '{has}', 's')"
    return f"SELECT conv_id, turn, '{name}' AS rule FROM a WHERE decision = 'answer' AND {asked} AND {bad}" + (f" AND NOT regexp_matches(lower(answer), '{lacks}')" if lacks else "")


@query(
    "ev_broken_rules",
    f"WITH a AS (SELECT conv_id, turn, unnest({sql_list(RULES)}) AS r, ({sql_list(ANSWERS)})[conv_id % {len(ANSWERS)} + 1] || ' ' || text AS answer, CASE WHEN turn % 5 = 4 THEN 'refuse' ELSE 'answer' END AS decision, turn % 3 AS evidence FROM conversations), "
    + "b AS (" + " UNION ALL ".join(sql_broken(*x) for x in T.ANSWER_RULES) + ") SELECT rule, count(*) AS n FROM b GROUP BY rule",
)
def ev_broken_rules(spark, sf):
    """How often each rule on answers is broken."""
    answer = F.concat(F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("conv_id") % len(ANSWERS) + 1).cast("int")), F.lit(" "), "text")
    broken = Q.broken_rules(answer, F.array(*map(F.lit, RULES)), F.when(F.col("turn") % 5 == 4, "refuse").otherwise("answer"), F.col("turn") % 3)
    return table(spark, sf, "conversations").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("txt_without_prices", "SELECT p_partkey, 'MK ' || p_name || ' và ' || chr(10) || chr(10) || 'Bảo hành 7 năm, số ' || p_size AS t FROM part")
def txt_without_prices(spark, sf):
    text = F.concat(F.lit("MK "), "p_name", F.lit(" và 613.700.000\n\nVNĐ\\*\n\n\nGiá bán từ\n 1.200.000 \nBảo hành 7 năm, số "), "p_size", F.lit("đồng 750000\n\n"))
    return table(spark, sf, "part").select("p_partkey", Q.without_prices(text).alias("t"))


@query(
    "txt_table_pieces",
    "SELECT p_brand, count(*)::INT AS pieces, sum(length(x))::BIGINT AS chars FROM (SELECT p_brand, '| k | v |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS x FROM (SELECT p_brand, p_partkey, '| ' || lpad(p_partkey::VARCHAR, 8, '0') || ' | row |' AS line, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 5 AS piece FROM part) GROUP BY p_brand, piece) GROUP BY p_brand",
)
def txt_table_pieces(spark, sf):
    """Tables cut into pieces of five rows by their length, the header on each."""
    line = F.concat(F.lit("| "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(" | row |"))
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("| k | v |\n|---|---|\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    pieces = rows.select("p_brand", Q.table_pieces(text, 5 * 19).alias("p"))
    return pieces.select("p_brand", F.size("p").alias("pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(
    "qry_fitted_history",
    """WITH t AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS j FROM conversations),
e AS (SELECT conv_id, sum(c) AS ends FROM t WHERE i = 1 OR j = 1 GROUP BY 1), m AS (SELECT t.*, ends + sum(c) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM t JOIN e USING (conv_id) WHERE i > 1 AND j > 1)
SELECT conv_id, ((SELECT least(count(*), 2) FROM t WHERE t.conv_id = e.conv_id) + (SELECT count(*) FROM m WHERE m.conv_id = e.conv_id AND used <= 100))::INT AS kept FROM e""",
)
def qry_fitted_history(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return rows.select("conv_id", F.size(Q.fitted_history(F.transform("m", lambda x: x["text"]), 100)).alias("kept"))


MK = ("MK 2", "MK 6", "MK 8")
ASKS = f"(SELECT conv_id, turn, q, {WANTS} AS wants, CASE WHEN turn % 3 <> 0 THEN 'MK 6' END AS model FROM (SELECT conv_id, turn, {SAY.format('conv_id + turn')} AS q, CASE WHEN turn % 2 = 0 THEN 'battery' ELSE 'general' END AS topic FROM conversations))"
CALL = lambda tool, model="model": f"{{'tool': '{tool}', 'model': {model}}}"


@query(
    "qry_tool_plan",
    rf"""SELECT conv_id, turn, p.tool, p.model, step FROM (SELECT conv_id, turn, unnest(p) AS p, generate_subscripts(p, 1)::INT - 1 AS step FROM (SELECT conv_id, turn, CASE WHEN wants IN ('out_of_scope', 'greeting', 'thanks', 'identity') THEN []
  WHEN wants = 'utility' THEN CASE {' '.join(f"WHEN regexp_matches(lower(q), '{p}') THEN [{CALL(t)}]" for t, p in T.UTILITIES)} ELSE [{CALL('get_showroom_charging_link', 'NULL')}] END
  WHEN wants IN ('price', 'versions_list') THEN CASE WHEN model IS NOT NULL THEN [{CALL('get_price')}] END WHEN wants IN ('spec_query', 'feature_presence') THEN CASE WHEN model IS NOT NULL THEN [{CALL('get_specs')}] END
  WHEN wants = 'cross_model_feature' THEN [{', '.join(CALL('get_specs', repr(m)) for m in MK)}]
  WHEN wants = 'compare' THEN CASE WHEN model IS NULL THEN NULL WHEN regexp_matches(lower(q), '{T.PRICE_ASKED}') THEN [{CALL('get_specs')}, {CALL('get_price')}] ELSE [{CALL('get_specs')}] END
  WHEN wants = 'models_list' THEN [{CALL('list_available_models', 'NULL')}] WHEN wants = 'colors' THEN CASE WHEN model IS NOT NULL THEN [{CALL('get_colors')}] END ELSE [{CALL('search_knowledge_base')}] END AS p FROM {ASKS}))""",
)
def qry_tool_plan(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", say(F.col("conv_id") + F.col("turn")).alias("q"), F.when(F.col("turn") % 2 == 0, "battery").otherwise("general").alias("topic"), F.when(F.col("turn") % 3 != 0, "MK 6").alias("model"))
    plan = Q.tool_plan(Q.question_intent(F.col("q"), F.col("topic")), F.col("q"), F.col("model"), MK)
    return rows.select("conv_id", "turn", F.posexplode(plan).alias("step", "p")).select("conv_id", "turn", "step", "p.tool", "p.model")


SOURCES = "s AS (SELECT doc_id % 100 AS question, (['get_specs', 'get_price', 'search_knowledge_base', 'get_colors'])[doc_id % 7 % 4 + 1] AS tool, (doc_id % 10) / 10.0 AS score, doc_id % 3 = 0 AS injected, doc_id % 2 = 0 AS by_price FROM documents)"


@query(
    "qry_evidence_class",
    f"""WITH {SOURCES}, t AS (SELECT question, tool, CASE WHEN tool = 'get_price' THEN CASE WHEN by_price THEN 0.9 ELSE 0.5 END WHEN tool = 'get_colors' THEN 0.9 ELSE score END AS score, injected FROM s WHERE tool <> 'get_colors' OR question % 5 = 0)
SELECT question, CASE WHEN bool_or(CASE tool WHEN 'get_specs' THEN score >= 0.5 WHEN 'get_price' THEN score >= 0.7 WHEN 'search_knowledge_base' THEN score >= 0.5 AND NOT injected ELSE true END) THEN 'direct_support'
  WHEN bool_or(CASE tool WHEN 'get_specs' THEN true WHEN 'get_price' THEN true WHEN 'search_knowledge_base' THEN score >= 0.3 ELSE true END) THEN 'partial_support' ELSE 'insufficient' END AS evidence FROM t GROUP BY question""",
)
def qry_evidence_class(spark, sf):
    """How well the sources found for a question support an answer; any source of a kind that is good enough decides."""
    tool = F.element_at(F.array(*map(F.lit, ("get_specs", "get_price", "search_knowledge_base", "get_colors"))), (F.col("doc_id") % 7 % 4 + 1).cast("int"))
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("question"), tool.alias("tool"), ((F.col("doc_id") % 10) / 10.0).alias("found"), (F.col("doc_id") % 3 == 0).alias("injected"), (F.col("doc_id") % 2 == 0).alias("by_price"))
    rows = rows.where("tool <> 'get_colors' OR question % 5 = 0")
    t, score = F.col("tool"), F.when(F.col("tool") == "get_price", F.when(F.col("by_price"), 0.9).otherwise(0.5)).when(F.col("tool") == "get_colors", 0.9).otherwise(F.col("found"))
    direct = F.when(t == "get_specs", score >= 0.5).when(t == "get_price", score >= 0.7).when(t == "search_knowledge_base", (score >= 0.5) & ~F.col("injected")).otherwise(True)
    partial = F.when(t == "search_knowledge_base", score >= 0.3).otherwise(True)
    got = rows.groupBy("question").agg(F.bool_or(direct).alias("direct"), F.bool_or(partial).alias("partial"))
    return got.select("question", F.when(F.col("direct"), "direct_support").when(F.col("partial"), "partial_support").otherwise("insufficient").alias("evidence"))


JUNK = "CASE WHEN doc_id % 6 = 0 THEN '- Giá bán' || chr(10) || '- Nội thất' || chr(10) || ' x' WHEN doc_id % 6 = 1 THEN text || ' Đặt lịch  sửa chữa đặt lịch sửa chữa' WHEN doc_id % 6 = 2 THEN text || chr(10) || '-  Nội thất ' || chr(10) || 'x' WHEN doc_id % 12 = 3 THEN 'MK 6  Hero banner ' || text ELSE text END"
SECTION = "CASE WHEN doc_id % 9 = 4 THEN 'Tiện ích ' ELSE source END"


@query(
    "txt_page_junk",
    f"""SELECT doc_id FROM (SELECT doc_id, {STRIP % f'({SECTION})'} AS s, {STRIP % f'({JUNK})'} AS t FROM documents) WHERE NOT (trim(s) IN ({', '.join(f"'{x}'" for x in T.JUNK_SECTIONS)}) OR regexp_matches(t, '{T.JUNK_TEXT}', 's')
  OR (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(trim(x), '{T.MENU_ITEM}'))) >= 2 AND 2 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(trim(x), '{T.MENU_ITEM}'))) >= len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''))) OR regexp_matches(t, '{T.LEADING_ITEM}'))""",
)
def txt_page_junk(spark, sf):
    n = F.col("doc_id")
    text = F.when(n % 6 == 0, "- Giá bán\n- Nội thất\n x").when(n % 6 == 1, F.concat("text", F.lit(" Đặt lịch  sửa chữa đặt lịch sửa chữa")))
    text = text.when(n % 6 == 2, F.concat("text", F.lit("\n-  Nội thất \nx"))).when(n % 12 == 3, F.concat(F.lit("MK 6  Hero banner "), "text")).otherwise(F.col("text"))
    section = F.array(F.when(n % 9 == 4, "Tiện ích ").otherwise(F.col("source")))
    return table(spark, sf, "documents").where(~Q.is_page_junk(section, text)).select("doc_id")


OTHERS = ("idiot", "scum", "licensed")


@query(
    "txt_of_others",
    f"SELECT doc_id, contains(t, 'src 1') OR contains(t, 'src1') OR contains(t, 'own brand') AS named, ({' OR '.join(f"contains(t, '{b}')" for b in OTHERS)}) AND NOT (contains(t, 'src 1') OR contains(t, 'src1') OR contains(t, 'own brand')) AS of_others FROM (SELECT doc_id, {STRIP % "(text || CASE doc_id % 4 WHEN 0 THEN ' SRC1' WHEN 1 THEN ' Own Brand' ELSE '' END)"} AS t FROM documents)",
)
def txt_of_others(spark, sf):
    """Texts filed under one model that speak of other brands alone."""
    n = F.col("doc_id")
    text = F.concat("text", F.when(n % 4 == 0, " SRC1").when(n % 4 == 1, " Own Brand").otherwise(""))
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    named = F.lower("text").rlike("src ?1|own brand")
    return rows.select("doc_id", named.alias("named"), Q.is_of_others(F.col("text"), F.lit("SRC 1"), ("own brand",), OTHERS).alias("of_others"))


@query(
    "txt_spec_tables",
    f"SELECT doc_id FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '|a|b|c|d Công suất' WHEN 1 THEN '|||| other' WHEN 2 THEN ' sạc nhanh' ELSE '' END AS t FROM documents) WHERE doc_id % 7 = 3 OR (length(t) - length(replace(t, '|', '')) >= 4 AND ({' OR '.join(f"contains({STRIP % 't'}, '{x}')" for x in T.SPEC_LABELS)}))",
)
def txt_spec_tables(spark, sf):
    n = F.col("doc_id") % 5
    text = F.concat("text", F.when(n == 0, "|a|b|c|d Công suất").when(n == 1, "|||| other").when(n == 2, " sạc nhanh").otherwise(""))
    section = F.array(F.lit("Tổng quan"), F.when(F.col("doc_id") % 7 == 3, " Thông số kỹ thuật").otherwise("Khác"))
    return table(spark, sf, "documents").select("doc_id", text.alias("t"), section.alias("s")).where(Q.is_spec_table(F.col("t"), F.col("s"))).select("doc_id")


VARIANTS = ("giá MK 6 bản Eco", "mk8 the all new thế nào", "MK 2 Plus AWD", "bản cao cấp", "so sánh", "mk 6 new", "Plus Captain MK 9")
WHICH = f"({sql_list(VARIANTS)})[(conv_id * 3 + turn) % {len(VARIANTS)} + 1]"


@query(
    "qry_model_edition",
    rf"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), 'mk\s*[0-9]+') THEN 'MK ' || regexp_extract(lower(q), 'mk\s*([0-9]+)', 1) END AS model, CASE {' '.join(f"WHEN contains(lower(q), '{n}') THEN '{v}' " for n, v in sorted(T.EDITIONS, key=lambda x: -len(x[0])))} END AS edition FROM (SELECT conv_id, turn, {WHICH} || ' ' || text AS q FROM conversations)",
)
def qry_model_edition(spark, sf):
    q = F.concat(F.element_at(F.array(*map(F.lit, VARIANTS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(VARIANTS) + 1).cast("int")), F.lit(" "), "text")
    number = F.nullif(F.regexp_extract(F.lower(q), r"mk\s*([0-9]+)", 1), F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("MK "), number).alias("model"), Q.edition_named(q).alias("edition"))


@query(
    "ev_judge_scores",
    "SELECT source, count(*) AS cases, round(avg(quality), 4) AS faithful, round(avg(1 - toxic), 4) AS relevant, round(avg(least(1.0, length(text) / 1000.0)), 4) AS complete, round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1 END), 4) AS grounded, round(avg(doc_id % 900), 1) AS latency_ms, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS answers, count(*) FILTER (WHERE toxic = 1) AS refusals, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS clarifications FROM documents JOIN labels USING (doc_id) GROUP BY source",
)
def ev_judge_scores(spark, sf):
    """Four scores, latency and decisions of judged answers."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("chars")).join(table(spark, sf, "labels"), "doc_id")
    mean = lambda c, d=4: F.round(F.avg(c), d)
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return rows.groupBy("source").agg(
        F.count("*").alias("cases"), mean("quality").alias("faithful"), mean(1 - F.col("toxic")).alias("relevant"), mean(F.least(F.lit(1.0), F.col("chars") / 1000.0)).alias("complete"), mean(F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(1.0)).alias("grounded"),
        mean(F.col("doc_id") % 900, 1).alias("latency_ms"), F.count_if(good & ~toxic).alias("answers"), F.count_if(toxic).alias("refusals"), F.count_if(~good & ~toxic).alias("clarifications"),
    )


WORDS = (("small", "blue", "size"), ("red", "ring"), ("bolt", "price"))
FOUND_IN = lambda t, g: f"len(list_intersect({t}, {sql_list(g)})) > 0"


@query(
    "qry_spec_relevance",
    f"""SELECT p_partkey, CASE WHEN {' OR '.join(f"({FOUND_IN('q', g)} AND {FOUND_IN('s', g)})" for g in WORDS)} THEN 0.9 WHEN len(list_intersect(q, s)) > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS score
FROM (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name), '[a-zà-ỹ0-9]+'), lambda t: length(t) > 1) AS s, ([['blue', 'price'], ['widget'], ['ring'], ['none']])[p_partkey % 4 + 1] AS q FROM part)""",
)
def qry_spec_relevance(spark, sf):
    question = F.element_at(F.array(*map(F.lit, ("blue price", "widget", "ring", "none"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", Q.spec_relevance(question, F.col("p_name"), WORDS).alias("score"))
