"""Queries over the term-weight index and the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators import index as X
from ..operators import retrieval as R
from .base import query, table
from .corpus import TOKENS

INDEX = f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM t),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), c AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT doc_id, term, idf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM
  (SELECT c.*, n_docs, avgdl, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS idf FROM c JOIN f USING (term), st))"""
ASKED = f""", b AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), q AS (SELECT item_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 / avgdl)) AS qw FROM
  (SELECT item_id, term, count(*) AS tf FROM b GROUP BY 1, 2) JOIN (SELECT DISTINCT term, idf FROM w) USING (term), st),
s AS (SELECT item_id, doc_id, round(sum(qw * weight), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
sp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10)"""
DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label AS vl, round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 6) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""


def stored(spark, sf):
    return X.opened(spark, table(spark, sf, "documents").select("doc_id", "text"))


def sparse(spark, sf, k=10):
    return X.sparse_top(stored(spark, sf), table(spark, sf, "benchmark"), "item_id", k)


def asked_vectors(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def dense(spark, sf, k=10, same=None):
    return R.dense_top(table(spark, sf, "embeddings"), asked_vectors(spark, sf), k, same)


def same_or_zero(asked, label):
    return (label == asked) | (label == 0)


@query("ret_df_idf", INDEX + " SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, st")
def ret_df_idf(spark, sf):
    docs = table(spark, sf, "documents")
    df = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("ret_bm25_weights", INDEX + " SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 6) AS most FROM w GROUP BY doc_id")
def ret_bm25_weights(spark, sf):
    """The weights of the stored index, by document."""
    return stored(spark, sf).table("weights").groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 6).alias("most"))


@query("ret_sparse_topk", INDEX + ASKED + " SELECT item_id, doc_id, rank, score FROM sp")
def ret_sparse_topk(spark, sf):
    return sparse(spark, sf).select("item_id", "doc_id", "rank", "score")


@query("ret_knn_topk", f"WITH {DENSE} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, score FROM k QUALIFY rank <= 10")
def ret_knn_topk(spark, sf):
    return dense(spark, sf).select("query_id", "vec_id", "rank", "score")


@query("ret_knn_filtered", f"WITH {DENSE} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, score FROM k WHERE ql = vl OR vl = 0 QUALIFY rank <= 5")
def ret_knn_filtered(spark, sf):
    return dense(spark, sf, 5, same_or_zero).select("query_id", "vec_id", "rank", "score")


FUSED = f"""{DENSE}, r1 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 10),
r2 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k WHERE ql = vl OR vl = 0 QUALIFY rank <= 10),
fu AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2)"""


@query("ret_rrf", f"WITH {FUSED} SELECT query_id, vec_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id)::INT AS rank, round(rrf / max(rrf) OVER (PARTITION BY query_id), 4) AS score FROM fu QUALIFY rank <= 5")
def ret_rrf(spark, sf):
    return R.fused([dense(spark, sf), dense(spark, sf, 10, same_or_zero)], "query_id", "vec_id", 5)


@query(
    "ret_enrich_left",
    """SELECT doc_id, coalesce(nullif(t, ''), text) AS text_head, coalesce(nullif(s, ''), source) AS source_name FROM
  (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'hit ' || doc_id END AS t, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'src' END AS s FROM documents)
  LEFT JOIN (SELECT doc_id, substr(text, 1, 20) AS text, source FROM documents WHERE doc_id % 5 <> 0) USING (doc_id) WHERE coalesce(nullif(t, ''), text, '') <> ''""",
)
def ret_enrich_left(spark, sf):
    docs = table(spark, sf, "documents")
    hits = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("hit "), "doc_id")).alias("text_head"), F.when(F.col("doc_id") % 2 != 0, "src").alias("source_name"))
    payload = docs.where("doc_id % 5 <> 0").select("doc_id", F.substring("text", 1, 20).alias("text_head"), F.col("source").alias("source_name"))
    return R.filled(hits, payload, "doc_id", ["text_head", "source_name"])


@query(
    "ret_category_gap",
    f"""WITH {DENSE}, g AS (SELECT query_id, vl AS category, max(score) AS best FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, category) AS n, lead(best) OVER (PARTITION BY query_id ORDER BY best DESC, category) AS second FROM g)
SELECT query_id, category, best, round(best - coalesce(second, 0), 6) AS gap, best >= 0.25 AND round(best - coalesce(second, 0), 6) >= 0.02 AS specific FROM r WHERE n = 1""",
)
def ret_category_gap(spark, sf):
    best = R.dense_categories(table(spark, sf, "embeddings"), asked_vectors(spark, sf)).withColumn("category", F.col("category").cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "category")
    ranked = best.withColumns({"n": F.row_number().over(order), "second": F.lead("best").over(order)}).where("n = 1")
    gap = F.round(F.col("best") - F.coalesce("second", F.lit(0.0)), 6)
    return ranked.select("query_id", "category", "best", gap.alias("gap"), ((F.col("best") >= 0.25) & (gap >= 0.02)).alias("specific"))


@query(
    "ret_hybrid",
    INDEX
    + ASKED
    + f""", {DENSE}, d0 AS (SELECT query_id // 50 AS item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 10),
u AS (SELECT item_id, doc_id, rank FROM sp UNION ALL SELECT item_id, doc_id, rank FROM d0 WHERE item_id IN (SELECT item_id FROM benchmark)),
fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf FROM u GROUP BY 1, 2),
n AS (SELECT fu.*, row_number() OVER (PARTITION BY item_id, lower(trim(text)) ORDER BY rrf DESC, doc_id) AS copy FROM fu JOIN documents USING (doc_id) WHERE trim(text) <> '')
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id)::INT AS rank, round(rrf / max(rrf) OVER (PARTITION BY item_id), 4) AS score FROM n WHERE copy = 1 QUALIFY rank <= 5""",
)
def ret_hybrid(spark, sf):
    """Sparse and dense lists, fused by rank, one hit per text, five per query."""
    near = dense(spark, sf).select((F.col("query_id") / 50).cast("long").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    near = near.join(table(spark, sf, "benchmark").select("item_id"), "item_id", "left_semi")
    both = sparse(spark, sf).select("item_id", "doc_id", "rank").unionByName(near)
    summed = both.groupBy("item_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("rrf"))
    texts = table(spark, sf, "documents").select("doc_id", F.md5(F.lower(F.btrim("text"))).alias("same"), (F.btrim("text") != "").alias("some")).where("some")
    first = Window.partitionBy("item_id", "same").orderBy(F.desc("rrf"), "doc_id")
    single = summed.join(texts, "doc_id").withColumn("copy", F.row_number().over(first)).where("copy = 1")
    best = F.max("rrf").over(Window.partitionBy("item_id"))
    order = Window.partitionBy("item_id").orderBy(F.desc("rrf"), "doc_id")
    return single.withColumns({"rank": F.row_number().over(order), "score": F.round(F.col("rrf") / best, 4)}).where("rank <= 5").select("item_id", "doc_id", "rank", "score")


@query(
    "ret_citations",
    "SELECT source, count(*) AS n_chunks, count(DISTINCT lang) AS n_languages, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY source",
)
def ret_citations(spark, sf):
    """Every source with all its chunks, as counts and digests."""
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("lang").alias("n_languages"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("doc_id").alias("id_sum"))
    return rows


@query(
    "ret_score_floor",
    f"WITH {DENSE} SELECT query_id, count(*) AS hits, min(score) AS least FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM k) WHERE n <= 5 AND score >= 0.3 GROUP BY query_id",
)
def ret_score_floor(spark, sf):
    """Of the five best hits those of 0.3 or more."""
    return dense(spark, sf, 5).where("score >= 0.3").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("least"))


@query(
    "ret_sorted_postings",
    INDEX + f" SELECT term, doc_id // {X.BLOCK} AS block, count(*) AS docs, round(max(weight), 6) AS most, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM w GROUP BY ALL",
)
def ret_sorted_postings(spark, sf):
    """The postings of every term, in the order of the documents, block by block, with each block's largest weight."""
    return stored(spark, sf).table("postings").select("term", "block", F.size("ids").cast("long").alias("docs"), F.round("most", 6).alias("most"), F.md5(F.array_join("ids", ",")).alias("ids"))


@query(
    "ret_sparse_vectors",
    INDEX + " SELECT doc_id, count(*) AS n, md5(string_agg(term, ',' ORDER BY term)) AS terms, round(sum(weight), 4) AS total, round(arg_min(weight, term), 6) AS first, round(arg_max(weight, term), 6) AS last FROM w GROUP BY doc_id",
)
def ret_sparse_vectors(spark, sf):
    """Every document's sparse vector, its terms in order."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return stored(spark, sf).table("vectors").select("doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", ",")).alias("terms"), F.round(total, 4).alias("total"), F.round(F.get("weights", F.lit(0)), 6).alias("first"), F.round(F.element_at("weights", -1), 6).alias("last"))


#: A question without a known term now and then: then the dense list counts alone.
WITHOUT_TERMS = 7
SEARCHED = f""", {DENSE}, d0 AS (SELECT query_id // 50 AS item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 10),
u AS (SELECT item_id, doc_id, rank FROM sp WHERE item_id % {WITHOUT_TERMS} <> 0 UNION ALL SELECT item_id, doc_id, rank FROM d0 WHERE item_id IN (SELECT item_id FROM benchmark)),
fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf FROM u GROUP BY 1, 2),
n AS (SELECT fu.*, row_number() OVER (PARTITION BY item_id, trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) ORDER BY rrf DESC, doc_id) AS copy FROM fu JOIN documents USING (doc_id) WHERE trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS place FROM n WHERE copy = 1),
re AS (SELECT o.*, CASE WHEN place > 10 THEN round(rrf, 4) WHEN q.e IS NULL OR v.e IS NULL THEN 0 ELSE round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 4) END AS score
  FROM o LEFT JOIN v q ON q.vec_id = 50 * o.item_id LEFT JOIN v ON v.vec_id = o.doc_id)"""


@query("ret_hybrid_search", INDEX + ASKED + SEARCHED + " SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place)::INT AS rank, score FROM re QUALIFY rank <= 5")
def ret_hybrid_search(spark, sf):
    """Sparse and dense lists fused by rank (the dense one alone where no term is known), one hit per text, the first ten rescored by cosine."""
    asked = table(spark, sf, "benchmark").where(f"item_id % {WITHOUT_TERMS} <> 0")
    lists = X.sparse_top(stored(spark, sf), asked, "item_id", 10).select("item_id", "doc_id", "rank")
    near = dense(spark, sf).select((F.col("query_id") / 50).cast("long").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    near = near.join(R.small(table(spark, sf, "benchmark").select("item_id")), "item_id", "left_semi")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("item_id"), F.col("embedding").alias("q"))
    return R.rescored(R.single(R.fused_scores([lists, near], "item_id", "doc_id"), table(spark, sf, "documents"), "item_id", "doc_id"), vectors, queries, "item_id", "doc_id", 5)


@query(
    "ret_knowledge_search",
    INDEX + ASKED + SEARCHED + ", fin AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place)::INT AS rank, score FROM re QUALIFY rank <= 5) SELECT item_id, fin.doc_id, rank, score, source, lang FROM fin JOIN documents USING (doc_id) WHERE score >= 0.3",
)
def ret_knowledge_search(spark, sf):
    """Of the five best hits of a question those of 0.3 or more, with what a citation needs."""
    hits = ret_hybrid_search(spark, sf).where("score >= 0.3")
    return hits.join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select("item_id", "doc_id", "rank", "score", "source", "lang")
