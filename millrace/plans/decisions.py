"""Queries that decide on conversations' turns: what they name and are about, what is done, and whether answers stand on evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import questions as Q
from ..functions import tables as T
from ..functions.products import model_pattern
from ..functions.text import TOKEN
from ..operators import evidence as E
from ..streaming import folds
from .base import query, table
from .questions import ASK, ASKED, SAY, SPEC_CASES, SPEC_GROUP, WANTS, say, sql_list

KEYS = ("power_kw", "range_km", "battery_kwh", "head_up_display", "airbags", "seats", "wheelbase_mm", "surround_view_camera", "display_inch", "ac_type", "trunk_capacity", "fast_charge_min", "sunroof_type")
KEY = f"({sql_list(KEYS)})[p_partkey % {len(KEYS)} + 1]"
GROUPS = ", ".join(f"('{g}', {sql_list(phrases)})" for g, phrases in T.SPEC_WORDS)
WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{TOKEN}'))"


def spec_key(key):
    return F.element_at(F.array(*map(F.lit, KEYS)), (F.col(key) % len(KEYS) + 1).cast("int"))


@query(
    "qry_spec_matches",
    f"""WITH g AS (SELECT DISTINCT grp, unnest(flatten(list_transform(phrases, lambda p: regexp_extract_all(p, '{TOKEN}')))) AS token FROM (VALUES {GROUPS}) x(grp, phrases)),
q AS (SELECT conv_id, turn, 'Brand#' || (conv_id % 25 + 1) AS brand, unnest({WORDS(ASK.format('(conv_id + turn)') + " || ' ' || text")}) AS token FROM conversations WHERE role = 'user'),
s AS (SELECT p_partkey, p_brand AS brand, unnest({WORDS(KEY + " || ' ' || p_name")}) AS token FROM part),
qg AS (SELECT DISTINCT conv_id, turn, brand, grp FROM q JOIN g USING (token)), sg AS (SELECT DISTINCT p_partkey, brand, grp FROM s JOIN g USING (token)),
m AS (SELECT conv_id, turn, p_partkey, 0.9::DOUBLE AS score FROM qg JOIN sg USING (brand, grp) UNION ALL SELECT conv_id, turn, p_partkey, 0.7 FROM q JOIN s USING (brand, token))
SELECT conv_id, turn, p_partkey, max(score) AS score FROM m GROUP BY ALL""",
)
def qry_spec_matches(spark, sf):
    """The specifications of its product that each question is about."""
    turns = table(spark, sf, "conversations").where("role = 'user'")
    questions = turns.select(F.concat(F.lit("Brand#"), F.col("conv_id") % 25 + 1).alias("brand"), F.struct("conv_id", "turn").alias("question"), F.concat(ask_of_turn(), F.lit(" "), "text").alias("text"))
    specs = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("spec"), spec_key("p_partkey").alias("key"), F.col("p_name").alias("value"))
    return E.relevance(questions, specs, E.word_groups(spark), ["brand"]).select("question.conv_id", "question.turn", F.col("spec").alias("p_partkey"), "score")


def ask_of_turn():
    return F.element_at(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED) + 1).cast("int"))


NAMING = ("", "mk 6 ", "", "Chiếc này, ", "MK8 the all new: ", "", "bản Plus, mk mpv 7 ", "", "", "mẫu này ")
SAID = f"CASE WHEN (conv_id + 3 * turn) % 4 = 0 THEN {SAY.format('conv_id * 5 + turn')} ELSE ({sql_list(NAMING)})[(conv_id + turn) % {len(NAMING)} + 1] || {SAY.format('conv_id * 5 + turn')} || ' ' || text END"


def said():
    word = say(F.col("conv_id") * 5 + F.col("turn"))
    naming = F.element_at(F.array(*map(F.lit, NAMING)), ((F.col("conv_id") + F.col("turn")) % len(NAMING) + 1).cast("int"))
    return F.when((F.col("conv_id") + 3 * F.col("turn")) % 4 == 0, word).otherwise(F.concat(naming, word, F.lit(" "), F.col("text")))


MODEL = model_pattern("mk")
SQL_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}', 's') THEN '{t}'" for t, p in T.TOPICS) + " END"
SO_FAR = "OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"
NO_MODEL = "(" + ", ".join(f"'{x}'" for x in T.WITHOUT_MODEL) + ")"
IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
SQL_NAMED = f"""u AS (SELECT conv_id, turn, {SAID} AS q FROM conversations WHERE role = 'user'),
f AS (SELECT *, regexp_extract(lower(q), '({MODEL})', 1) AS m, regexp_extract(lower(q), '({T.EDITION_NAMES})', 1) AS e, {SQL_TOPIC} AS own_topic FROM u),
n AS (SELECT *, CASE WHEN m = '' THEN NULL WHEN regexp_matches(m, '^mk\\s*[0-9]+') THEN CASE WHEN regexp_matches(m, 'new|mới|moi') THEN 'MK 8 All New' ELSE 'MK ' || regexp_extract(m, '([0-9]+)', 1) END
  WHEN contains(m, 'mpv') THEN 'MK MPV ' || regexp_extract(m, '([0-9]+)$', 1) ELSE 'MK E34' END AS own_model, CASE e {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.EDITIONS)} END AS own_edition FROM f),
c AS (SELECT conv_id, turn, q, last_value(own_model IGNORE NULLS) {SO_FAR} AS model, last_value(own_edition IGNORE NULLS) {SO_FAR} AS edition, last_value(own_topic IGNORE NULLS) {SO_FAR} AS known FROM n)"""


@query(
    "qry_decisions",
    f"""WITH {SQL_NAMED},
i AS (SELECT *, {SPEC_GROUP} AS grp, {WANTS} AS wants FROM (SELECT *, coalesce(known, 'general') AS topic FROM c)),
w AS (SELECT *, CASE WHEN wants = 'general' AND grp IS NOT NULL THEN 'spec_query' ELSE wants END AS intent FROM i),
d AS (SELECT *, CASE WHEN intent IN ('greeting', 'thanks', 'identity') THEN 'respond' WHEN intent = 'out_of_scope' THEN 'out_of_scope' WHEN model IS NULL AND (regexp_matches(lower(q), '{T.POINTING}') OR intent NOT IN {NO_MODEL}) THEN 'clarify' ELSE 'answer' END AS decision FROM w)
SELECT conv_id, turn, model, edition, topic, intent, decision,
  CASE decision WHEN 'respond' THEN intent WHEN 'out_of_scope' THEN decision WHEN 'clarify' THEN CASE WHEN regexp_matches(lower(q), '{T.POINTING}') THEN 'ambiguous_context' ELSE 'missing_model' END ELSE 'sufficient_direct_evidence' END AS reason,
  CASE WHEN decision = 'answer' AND intent IN {IN(T.WITH_GROUP)} THEN grp END AS spec_group, CASE WHEN decision = 'answer' AND intent IN {IN(T.WITH_KEY)} THEN CASE {SPEC_CASES} END END AS spec_key,
  decision = 'answer' AND intent = 'general' AND (model IS NOT NULL OR len(regexp_extract_all(q, '\\S+')) >= 4) AS fallback, CASE WHEN decision = 'answer' THEN CASE topic {" ".join(f"WHEN '{t}' THEN '{','.join(tools)}'" for t, tools in T.TOPIC_TOOLS)} END END AS tools FROM d""",
)
def qry_decisions(spark, sf):
    """What is done about every user's turn; model, edition and topic hold on from earlier turns, by the fold that streams use too."""
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("event_id"), F.col("turn").alias("at_ms"), said().alias("q"))
    own = turns.select("conv_id", "event_id", "at_ms", *[c.alias(n) for n, c in D.named(F.col("q")).items()])
    known = folds.batch(own, "conv_id", folds.carried, folds.CARRIED_OUT).select("conv_id", F.col("event_id").alias("turn"), "model", "edition", F.coalesce("topic", F.lit("general")).alias("topic"))
    rows = known.join(turns.select("conv_id", F.col("event_id").alias("turn"), "q"), ["conv_id", "turn"])
    made = D.decided(F.col("q"), F.col("model"), F.col("topic"))
    return rows.select("conv_id", "turn", "model", "edition", "topic", *[(F.array_join(c, ",") if n == "tools" else c).alias(n) for n, c in made.items()])


LISTED = "CASE WHEN regexp_matches(x, '^mk\\s*[0-9]+') THEN CASE WHEN regexp_matches(x, 'new|mới|moi') THEN 'MK 8 All New' ELSE 'MK ' || regexp_extract(x, '([0-9]+)', 1) END WHEN contains(x, 'mpv') THEN 'MK MPV ' || regexp_extract(x, '([0-9]+)$', 1) ELSE 'MK E34' END"
MAIN = ("MK 2", "MK 6", "MK 8")
OF_EACH = lambda tool: f"list_transform(named, lambda m: '{tool}:' || m)"
ONE = lambda tool: f"CASE WHEN model IS NOT NULL THEN ['{tool}:' || model] END"


@query(
    "qry_tool_calls",
    f"""WITH {SQL_NAMED},
i AS (SELECT *, {WANTS} AS wants, list_sort(list_distinct(list_filter(list_append(list_transform(regexp_extract_all(lower(q), '{MODEL}'), lambda x: {LISTED}), model), lambda x: x IS NOT NULL))) AS named FROM (SELECT *, coalesce(known, 'general') AS topic FROM c)),
p AS (SELECT conv_id, turn, CASE WHEN wants IN ('out_of_scope', 'greeting', 'thanks', 'identity') THEN [] WHEN wants = 'utility' THEN [CASE {" ".join(f"WHEN regexp_matches(lower(q), '{u}') THEN '{t}'" for t, u in T.UTILITIES)} ELSE 'get_showroom_charging_link' END || coalesce(':' || model, '')]
  WHEN wants IN ('price', 'versions_list') THEN {ONE('get_price')} WHEN wants IN ('spec_query', 'feature_presence') THEN {ONE('get_specs')} WHEN wants = 'cross_model_feature' THEN {sql_list(f'get_specs:{m}' for m in MAIN)}
  WHEN wants = 'compare' THEN CASE WHEN len(named) > 0 THEN CASE WHEN regexp_matches(lower(q), '{T.PRICE_ASKED}') THEN list_concat({OF_EACH('get_specs')}, {OF_EACH('get_price')}) ELSE {OF_EACH('get_specs')} END END
  WHEN wants = 'models_list' THEN ['list_available_models'] WHEN wants = 'colors' THEN {ONE('get_colors')} ELSE ['search_knowledge_base' || coalesce(':' || model, '')] END AS calls FROM i)
SELECT conv_id, turn, array_to_string(calls, ',') AS calls FROM p""",
)
def qry_tool_calls(spark, sf):
    """What is looked up for every user's turn, for the product it names or that was named last; a comparison for all that it names."""
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("event_id"), F.col("turn").alias("at_ms"), said().alias("q"))
    own = turns.select("conv_id", "event_id", "at_ms", *[c.alias(n) for n, c in D.named(F.col("q")).items()])
    known = folds.batch(own, "conv_id", folds.carried, folds.CARRIED_OUT).join(turns.drop("at_ms"), ["conv_id", "event_id"])
    calls = Q.tool_plan(Q.question_intent(F.col("q"), F.coalesce("topic", F.lit("general"))), F.col("q"), F.col("model"), MAIN)
    return known.select("conv_id", F.col("event_id").alias("turn"), F.array_join(F.transform(calls, lambda c: F.concat_ws(":", c.tool, c.model)), ",").alias("calls"))


PRICE = "(p_partkey * 1000000 + 500000000)::BIGINT::VARCHAR"
CLAIMS = ("' Giá ' || {p}", "' Giá bán ' || ({p}::BIGINT + 1)", "' Công suất ' || p_size || ' kW, có HUD và ghế'", "' Xe không có HUD hay camera'", "' Có ghế massage, loa và 123 đèn, 2 cửa sổ'", "''")
FOUND = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{T.FEATURES}'))"
TIGHT = lambda x: f"regexp_replace(lower({x}), '[\\s\\-_]', '', 'g')"
NUMBERS = lambda x: f"list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '[0-9]+[-–][0-9]+', '', 'g'), '[0-9][0-9.,]*[0-9]|[0-9]+'), lambda n: regexp_replace(n, '[.,]', '', 'g')::DOUBLE))"


def sql_claimed(x: str) -> str:
    out = f"lower({x})"
    for p in T.NO_CLAIM:
        out = f"regexp_replace({out}, '{p}', '{'camera' if p.startswith('camera') else ''}', 'g')"
    return NUMBERS(out)


OF_KEY = "CASE " + " ".join(f"WHEN len(list_filter({sql_list(plain)}, lambda w: contains(lower(key), w))) > 0 THEN {sql_list(said_)}::VARCHAR[]" for plain, said_ in E.plain_words() if plain) + " ELSE [] END"
OTHERS = "CASE lower(key) " + " ".join(f"WHEN '{k}' THEN {sql_list(names)}" for k, names in T.KEY_ALIASES) + " ELSE [] END"


@query(
    "qry_claims_grounded",
    f"""WITH a AS (SELECT t.conv_id, t.turn, t.text || CASE (t.conv_id + t.turn) % {len(CLAIMS)} {" ".join(f"WHEN {i} THEN {c.format(p=PRICE)}" for i, c in enumerate(CLAIMS))} END AS text, coalesce(u.text, '') || ' Xe có HUD không, bao nhiêu đèn?' AS question, p.*
  FROM conversations t JOIN part p ON p.p_partkey = t.conv_id LEFT JOIN (SELECT conv_id, turn, any_value(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL) u ON u.conv_id = t.conv_id AND u.turn = t.turn - 1 WHERE t.role = 'assistant'),
e AS (SELECT conv_id, turn, 'get_specs' AS tool, {KEY} AS key, p_size || ' kW ' || p_name AS value FROM a WHERE conv_id % 5 <> 0
  UNION ALL SELECT conv_id, turn, 'get_price', p_type, {PRICE} FROM a WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, turn, 'search_knowledge_base', '', d.text FROM a JOIN documents d ON d.doc_id = conv_id WHERE conv_id % 4 = 1),
x AS (SELECT conv_id, turn, tool, list_filter(CASE tool WHEN 'get_specs' THEN list_concat([lower(key)], {FOUND('key')}, {FOUND('value')}, {OF_KEY}, {OTHERS}) WHEN 'get_price' THEN ['giá', 'price'] ELSE {FOUND("coalesce(value, '')")} END, lambda t: t <> '') AS terms,
  lower(CASE tool WHEN 'get_specs' THEN concat_ws(' ', array_to_string({OTHERS}, ' '), key, value) ELSE concat_ws(' ', key, value) END) AS raw, {NUMBERS("coalesce(value, '')")} AS nums FROM e),
k AS (SELECT conv_id, turn, bool_and(tool = 'get_price') AS only_price, bool_or(tool = 'get_price' AND len(nums) > 0) AS has_amount, bool_or(len(terms) > 0 OR trim(raw) <> '') AS has_context FROM x GROUP BY ALL),
c AS (SELECT conv_id, turn, {FOUND('text')} AS f, regexp_matches(lower(text), '{T.NEGATIVE}') AS neg, {FOUND('question')} AS qf, regexp_matches(lower(text), '{T.PRICE_TALK}') AS of_price,
  list_filter({sql_claimed('text')}, lambda n: NOT list_contains({NUMBERS('question')}, n) AND NOT (n BETWEEN 1 AND 9)) AS n FROM a),
fm AS (SELECT conv_id, turn, feat, bool_or(CASE WHEN neg AND list_contains(qf, feat) THEN contains({TIGHT('raw')}, {TIGHT('feat')}) OR contains(raw, feat)
   ELSE contains({TIGHT('raw')}, {TIGHT('feat')}) OR contains(raw, feat) OR len(list_filter(terms, lambda t: contains({TIGHT('t')}, {TIGHT('feat')}) OR contains({TIGHT('feat')}, {TIGHT('t')}))) > 0 END) AS ok
  FROM (SELECT *, unnest(f) AS feat FROM c) JOIN x USING (conv_id, turn) GROUP BY ALL),
nm AS (SELECT conv_id, turn, num, of_price, bool_or(list_contains(nums, num)) AS known, bool_or((tool = 'get_price' AND list_contains(nums, num)) OR (tool = 'get_specs' AND len(list_filter(nums, lambda s: s > 1000 AND abs(num - s) / s < 0.01)) > 0)) AS priced
  FROM (SELECT *, unnest(n) AS num FROM c) JOIN x USING (conv_id, turn) GROUP BY ALL),
u AS (SELECT conv_id, turn, count(*) FILTER (WHERE NOT ok) AS unmatched FROM fm GROUP BY ALL), b AS (SELECT conv_id, turn, count(*) FILTER (WHERE NOT known OR (of_price AND has_amount AND NOT priced)) AS bad FROM nm JOIN k USING (conv_id, turn) GROUP BY ALL)
SELECT c.conv_id, c.turn, len(f)::INT AS n_features, coalesce(unmatched, 0) AS unmatched, coalesce(bad, 0) AS bad_numbers,
  k.only_price IS NOT NULL AND (len(f) = 0 OR NOT has_context OR 2 * coalesce(unmatched, 0) < len(f)) AND (only_price OR coalesce(bad, 0) = 0) AS grounded FROM c LEFT JOIN k USING (conv_id, turn) LEFT JOIN u USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""",
)
def qry_claims_grounded(spark, sf):
    """Whether every answer's features and numbers stand in what was looked up for it."""
    turns, parts = table(spark, sf, "conversations"), table(spark, sf, "part")
    price = (F.col("p_partkey") * 1000000 + 500000000).cast("string")
    kw = F.concat(F.col("p_size").cast("string"), F.lit(" kW"))
    claims = (F.concat(F.lit(" Giá "), price), F.concat(F.lit(" Giá bán "), price.cast("long") + 1), F.concat(F.lit(" Công suất "), kw, F.lit(", có HUD và ghế")), F.lit(" Xe không có HUD hay camera"), F.lit(" Có ghế massage, loa và 123 đèn, 2 cửa sổ"), F.lit(""))
    claim = F.element_at(F.array(*claims), ((F.col("conv_id") + F.col("turn")) % len(claims) + 1).cast("int"))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q")).dropDuplicates(["conv_id", "turn"])
    a = turns.where("role = 'assistant'").join(parts, F.col("p_partkey") == F.col("conv_id")).join(asked, ["conv_id", "turn"], "left")
    a = a.select("conv_id", "turn", F.concat("text", claim).alias("text"), F.concat(F.coalesce("q", F.lit("")), F.lit(" Xe có HUD không, bao nhiêu đèn?")).alias("question"), "p_partkey", "p_type", kw.alias("kw"), "p_name", price.alias("price"))
    piece = lambda rows, tool, key, value: rows.select("conv_id", "turn", F.lit(tool).alias("tool"), key.alias("key"), value.alias("value"))
    found = piece(a.where("conv_id % 5 <> 0"), "get_specs", spec_key("p_partkey"), F.concat_ws(" ", "kw", "p_name")).unionByName(piece(a.where("conv_id % 3 = 0"), "get_price", F.col("p_type"), F.col("price")))
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    found = found.unionByName(piece(a.where("conv_id % 4 = 1").join(texts, F.col("doc_id") == F.col("conv_id")), "search_knowledge_base", F.lit(""), F.col("body")))
    return E.grounded(a, found, ["conv_id", "turn"])
