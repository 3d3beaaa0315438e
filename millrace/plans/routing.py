"""Queries that route questions; conversations stand for chats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import decisions as D
from ..functions import questions as Q
from ..functions import rules as X
from ..functions import tables as T
from ..functions.text import estimated_tokens, tokens
from ..operators import routing as R
from .base import query, table
from .corpus import TOKENS
from .decisions import SAID, SQL_NAMED, SQL_TOPIC, said
from .questions import SPEC_GROUP, WANTS


def turns(spark, sf):
    return table(spark, sf, "conversations")


USERS = f"(SELECT conv_id, turn, {SAID} AS q, 'general' AS topic FROM conversations WHERE role = 'user')"
INTENT = f"SELECT conv_id, turn, q, {WANTS} AS intent FROM {USERS}"


def users(spark, sf):
    """The users' turns, with what they say as q."""
    return turns(spark, sf).where("role = 'user'").select("conv_id", "turn", said().alias("q"))


def intent():
    return Q.question_intent(F.col("q"), F.lit("general"))


@query("qry_intent", f"SELECT conv_id, turn, intent, intent = 'general' AND len(regexp_extract_all(q, '\\S+')) >= 4 AS needs_fallback FROM ({INTENT})")
def qry_intent(spark, sf):
    rows = users(spark, sf).withColumn("intent", intent())
    return rows.select("conv_id", "turn", "intent", ((F.col("intent") == "general") & (F.size(F.regexp_extract_all("q", F.lit(r"(\S+)"), F.lit(1))) >= 4)).alias("needs_fallback"))


@query("qry_spec_category", f"SELECT {SPEC_GROUP} AS category, count(*) AS n FROM {USERS} GROUP BY 1")
def qry_spec_category(spark, sf):
    return users(spark, sf).groupBy(X.first_match(F.col("q"), T.SPEC_GROUPS, None).alias("category")).agg(F.count("*").alias("n"))


@query("qry_topic", f"SELECT coalesce({SQL_TOPIC}, 'general') AS topic, count(*) AS n FROM {USERS} GROUP BY 1")
def qry_topic(spark, sf):
    return users(spark, sf).groupBy(D.topic(F.col("q")).alias("topic")).agg(F.count("*").alias("n"))


@query("qry_entities", f"WITH {SQL_NAMED} SELECT conv_id, turn, own_model AS model, own_edition AS edition FROM n")
def qry_entities(spark, sf):
    own = D.named(F.col("q"))
    return users(spark, sf).select("conv_id", "turn", own["model"].alias("model"), own["edition"].alias("edition"))


@query("qry_history_ctx", f"WITH {SQL_NAMED} SELECT conv_id, turn, model AS model_ctx FROM c")
def qry_history_ctx(spark, sf):
    rows = users(spark, sf).select("conv_id", "turn", D.named(F.col("q"))["model"].alias("model"))
    return R.inherited(rows, "model").select("conv_id", "turn", "model_ctx")


@query(
    "qry_history_sanitize",
    """WITH a AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations WHERE role IN ('user', 'assistant')),
b AS (SELECT *, row_number() OVER w AS f, lead(turn) OVER w AS l FROM a WHERE nx IS NULL OR nx <> role WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, role, CASE WHEN length(text) > CASE role WHEN 'user' THEN 4000 ELSE 16000 END THEN substr(text, 1, CASE role WHEN 'user' THEN 4000 ELSE 16000 END) || '…' ELSE text END AS text
  FROM b WHERE NOT (f = 1 AND role = 'assistant') AND NOT (l IS NULL AND role = 'user')),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tk FROM c)
SELECT conv_id, turn, role, length(text)::INT AS chars FROM d WHERE n <= 4 AND tk <= 600""",
)
def qry_history_sanitize(spark, sf):
    rows = R.sanitized(turns(spark, sf))
    return R.recent(rows, estimated_tokens(F.col("text")), 4, 600).select("conv_id", "turn", "role", F.length("text").alias("chars"))


PLAN = "CASE intent " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in R.PLANS.items()) + " ELSE [] END"


@query("qry_plan", f"SELECT conv_id, turn, unnest({PLAN}) AS tool, generate_subscripts({PLAN}, 1)::INT - 1 AS step FROM ({INTENT})")
def qry_plan(spark, sf):
    """The tools of every turn's intent, whatever product it is about."""
    return users(spark, sf).select("conv_id", "turn", F.posexplode(R.plan(intent())).alias("step", "tool"))


@query(
    "qry_evidence",
    f"""WITH q AS (SELECT conv_id, turn, unnest(list_distinct({TOKENS})) AS term FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, unnest(list_distinct({TOKENS})) AS term FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, count(*) AS n FROM q JOIN a USING (conv_id, turn, term) GROUP BY 1, 2),
e AS (SELECT conv_id, turn, CASE WHEN coalesce(n, 0) > 0 THEN least(0.9, round(0.3 + 0.1 * n, 6)) ELSE 0.0 END::DOUBLE AS score FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, turn, score, CASE WHEN score >= 0.5 THEN 'direct' WHEN score >= 0.2 THEN 'partial' ELSE 'none' END AS evidence FROM e""",
)
def qry_evidence(spark, sf):
    """How far the answer to each question shares its words; joined on (conversation, turn, term)."""
    t = turns(spark, sf)
    terms = lambda rows, turn: rows.select("conv_id", turn, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked, told = t.where("role = 'user'"), t.where("role = 'assistant'")
    shared = terms(asked, F.col("turn")).join(terms(told, (F.col("turn") - 1).alias("turn")), ["conv_id", "turn", "term"]).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    score = F.round(R.overlap_score(F.coalesce("n", F.lit(0))), 6)
    return asked.select("conv_id", "turn").join(shared, ["conv_id", "turn"], "left").select("conv_id", "turn", score.alias("score")).withColumn("evidence", R.evidence_class(F.col("score")))


@query("qry_chunks_rank", "SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id)::INT AS rank FROM (SELECT doc_id, source, len(list_intersect(string_split(lower(text), ' '), ['the', 'der', 'le', 'el', 'and', 'und'])) AS n FROM documents) WHERE n > 0) WHERE rank <= 30")
def qry_chunks_rank(spark, sf):
    hits = F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "der", "le", "el", "and", "und")))))
    rows = table(spark, sf, "documents").select("doc_id", "source", hits.alias("n")).where("n > 0")
    best = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= 30").select("doc_id", "source", "rank")


@query("qry_lookup_price", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part WHERE upper(p_brand) = upper('brand#3') ORDER BY p_retailprice, p_partkey LIMIT 10")
def qry_lookup_price(spark, sf):
    rows = table(spark, sf, "part").where(F.upper("p_brand") == F.upper(F.lit("brand#3")))
    return rows.orderBy("p_retailprice", "p_partkey").limit(10).select("p_partkey", "p_brand", "p_type", "p_retailprice")


@query("qry_lookup_specs", "SELECT p_partkey, coalesce(edition, 'ALL') AS edition, p_size FROM (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_type END AS edition, p_size, p_brand FROM part) WHERE p_brand IN ('Brand#2', 'Brand#3') AND (edition = 'SMALL' OR edition IS NULL) AND p_size <> 11")
def qry_lookup_specs(spark, sf):
    rows = table(spark, sf, "part").where(F.col("p_brand").isin("Brand#2", "Brand#3") & (F.col("p_size") != 11))
    rows = rows.withColumn("edition", F.when(F.col("p_size") % 9 != 0, F.col("p_type"))).where((F.col("edition") == "SMALL") | F.col("edition").isNull())
    return rows.select("p_partkey", F.coalesce("edition", F.lit("ALL")).alias("edition"), "p_size")


@query("qry_models_nested", "SELECT p_brand, list_sort(list_distinct(list(p_type))) AS editions, count(*) AS parts FROM part GROUP BY p_brand")
def qry_models_nested(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("editions"), F.count("*").alias("parts"))


@query("qry_models_union", "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part ORDER BY 1")
def qry_models_union(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select(F.col("p_brand").alias("name")).union(rows.select("p_type")).distinct().orderBy("name")


@query("qry_models_listagg", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS editions FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_type = 'LARGE') GROUP BY p_brand")
def qry_models_listagg(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    closed = rows.where("p_size = 1 AND p_type = 'LARGE' AND p_brand IS NOT NULL").select("p_brand").distinct()
    kept = rows.where("p_brand IS NOT NULL").join(closed, "p_brand", "left_anti")
    return kept.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("editions"))


@query("qry_reason_code", "SELECT CASE WHEN contains(event_type, 'purchase') THEN 'sold' WHEN contains(event_type, 'timeout') THEN 'timed_out' WHEN contains(event_type, 'error') THEN 'system_error' WHEN contains(event_type, 'time') THEN 'slow' WHEN contains(event_type, 'sign') THEN 'signed' ELSE 'none' END AS reason, count(*) AS n FROM events GROUP BY 1")
def qry_reason_code(spark, sf):
    return table(spark, sf, "events").groupBy(X.longest_key(F.col("event_type"), X.REASONS, "none").alias("reason")).agg(F.count("*").alias("n"))


@query("qry_grounding", f"WITH q AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT doc_id, list_distinct(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$'))) AS nums, list_distinct(t) AS d FROM q) SELECT doc_id, len(nums)::INT AS numbers, len(d)::INT AS words, len(nums) = 0 AS grounded FROM n")
def qry_grounding(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("d"))
    rows = rows.withColumn("nums", F.filter("d", lambda x: x.rlike("^[0-9]+$")))
    return rows.select("doc_id", F.size("nums").alias("numbers"), F.size("d").alias("words"), (F.size("nums") == 0).alias("grounded"))
