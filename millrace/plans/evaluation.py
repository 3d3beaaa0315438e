"""Evaluation queries: retrieval hits, decisions, facts, rules, conversations, judge scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import query, table
from .retrieval import ASKED, DENSE, INDEX, dense, sparse


@query(
    "ev_hit_at_k",
    f"""WITH {DENSE}, r AS (SELECT query_id, ql = vl AS match, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 5),
h AS (SELECT query_id, max(match::INT) AS hit, avg(match::INT) AS precision FROM r GROUP BY 1)
SELECT count(*) AS queries, round(avg(hit), 4) AS hit_rate, round(avg(precision), 4) AS precision, avg(hit) >= 0.8 AS passed FROM h""",
)
def ev_hit_at_k(spark, sf):
    label = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = dense(spark, sf, 5).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    each = hits.groupBy("query_id").agg(F.max((F.col("label") == F.col("wanted")).cast("int")).alias("hit"), F.avg((F.col("label") == F.col("wanted")).cast("int")).alias("precision"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("precision"), 4).alias("precision"), (F.avg("hit") >= 0.8).alias("passed"))


@query(
    "ev_relevant_share",
    INDEX + ASKED + " SELECT item_id, count(*) AS found, count(quality) AS judged, round(coalesce(avg(quality), 0), 4) AS precision FROM sp LEFT JOIN labels USING (doc_id) GROUP BY item_id",
)
def ev_relevant_share(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return sparse(spark, sf).join(labels, "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("found"), F.count("quality").alias("judged"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 4).alias("precision"))


@query(
    "ev_decision_accuracy",
    "SELECT source, count(*) AS cases, round(avg((CASE WHEN length(text) > 300 THEN 1 ELSE 0 END = quality)::INT), 4) AS accuracy, count(*) FILTER (WHERE quality = 0) AS negatives FROM documents JOIN labels USING (doc_id) GROUP BY source",
)
def ev_decision_accuracy(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.when(F.length("text") > 300, 1).otherwise(0).alias("said")).join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("said") == F.col("quality")).cast("int")), 4).alias("accuracy"), F.count_if(F.col("quality") == 0).alias("negatives"))


PAIRS = "p AS (SELECT u.conv_id, u.turn, u.text AS fact, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
WORDS = "regexp_extract_all(lower(fact), '[a-z]+')[1:3]"


def pairs(spark, sf):
    t = table(spark, sf, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("fact"))
    told = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def fact_found():
    words = F.slice(F.regexp_extract_all(F.lower("fact"), F.lit("([a-z]+)"), F.lit(1)), 1, 3)
    numbers = F.regexp_extract_all("fact", F.lit("([0-9]+)"), F.lit(1))
    return F.when(F.size(numbers) > 0, F.exists(numbers, lambda n: F.contains(F.col("answer"), n))).otherwise(F.exists(words, lambda w: F.contains(F.lower("answer"), w)))


FOUND = f"CASE WHEN len(regexp_extract_all(fact, '[0-9]+')) > 0 THEN len(list_filter(regexp_extract_all(fact, '[0-9]+'), lambda n: contains(answer, n))) > 0 ELSE len(list_filter({WORDS}, lambda w: contains(lower(answer), w))) > 0 END"


@query("ev_fact_recall", f"WITH {PAIRS} SELECT count(*) AS facts, count(*) FILTER (WHERE {FOUND}) AS found FROM p")
def ev_fact_recall(spark, sf):
    return pairs(spark, sf).agg(F.count("*").alias("facts"), F.count_if(fact_found()).alias("found"))


@query(
    "ev_rule_violations",
    f"WITH {PAIRS} SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(answer) > 1500 THEN 'too_long' END, CASE WHEN contains(answer, '|') THEN 'has_table' END, CASE WHEN length(answer) < length(fact) THEN 'shorter_than_question' END], lambda x: x IS NOT NULL)) AS rule FROM p) GROUP BY rule",
)
def ev_rule_violations(spark, sf):
    broken = F.array(F.when(F.length("answer") > 1500, "too_long"), F.when(F.contains(F.col("answer"), F.lit("|")), "has_table"), F.when(F.length("answer") < F.length("fact"), "shorter_than_question"))
    return pairs(spark, sf).select(F.explode(F.array_compact(broken)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("ev_conversation_pass", f"WITH {PAIRS} SELECT conv_id, bool_and({FOUND}) AS passed, count(*) AS turns FROM p GROUP BY conv_id")
def ev_conversation_pass(spark, sf):
    return pairs(spark, sf).groupBy("conv_id").agg(F.bool_and(fact_found()).alias("passed"), F.count("*").alias("turns"))


@query("ev_judge_means", "SELECT lang, round(avg(quality), 4) AS quality, round(avg(1 - toxic), 4) AS safety, round(avg(least(1.0, length(text) / 1000.0)), 4) AS depth, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def ev_judge_means(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("chars")).join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg(1 - F.col("toxic")), 4).alias("safety"), F.round(F.avg(F.least(F.lit(1.0), F.col("chars") / 1000.0)), 4).alias("depth"), F.count("*").alias("n"))


@query("ev_history_replay", "SELECT conv_id, turn, (count(*) OVER w)::INT AS history, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ev_history_replay(spark, sf):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(before).cast("int").alias("history"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars"))
