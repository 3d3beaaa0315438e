"""Catalogue queries; parts stand for models and editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import locale_number
from ..operators import catalog as C
from ..operators.runs import filled_forward
from .base import query, table

ALIASES = (("small", "S"), ("small ring", "SR"), ("red", "R"), ("red widget", "RW"), ("blue", "B"), ("blue b", "BB"))
VALUES = ", ".join(f"('{a}', '{t}', {i})" for i, (a, t) in enumerate(ALIASES))


def parts(spark, sf):
    return table(spark, sf, "part")


@query("cat_prefix_alias", f"SELECT p_partkey, (SELECT arg_max(target, (length(alias), -ord)) FROM (VALUES {VALUES}) a(alias, target, ord) WHERE starts_with(p_name, alias)) AS target FROM part")
def cat_prefix_alias(spark, sf):
    aliases = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(ALIASES)], "alias string, target string, ord int")
    return C.longest_alias(parts(spark, sf), "p_name", aliases).select("p_partkey", "target")


@query("cat_fill_forward", "SELECT p_partkey, last_value(h IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS header FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN p_name END AS h FROM part)")
def cat_fill_forward(spark, sf):
    rows = parts(spark, sf).withColumn("header", F.when(F.col("p_size") % 7 == 0, F.col("p_name")))
    return filled_forward(rows, ["p_brand"], "p_partkey", "header").select("p_partkey", "header")


@query("cat_dim_triple", "SELECT p_partkey, (4000 + p_size)::DOUBLE AS length_mm, (1000 + p_size * 3)::DOUBLE AS width_mm, (p_size + 0.5)::DOUBLE AS height FROM part")
def cat_dim_triple(spark, sf):
    size = F.col("p_size")
    text = F.concat(F.lit("4."), F.lpad(size.cast("string"), 3, "0"), F.lit(" x 1."), F.lpad((size * 3).cast("string"), 3, "0"), F.lit(" x "), size.cast("string"), F.lit(",5"))
    cut = F.split(text, r"\s*[x×]\s*")
    return parts(spark, sf).select("p_partkey", *[locale_number(F.get(cut, F.lit(i))).alias(n) for i, n in enumerate(("length_mm", "width_mm", "height"))])


@query("cat_min_price", "SELECT p_brand, p_type, min(p_retailprice) AS price, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY 1, 2")
def cat_min_price(spark, sf):
    return parts(spark, sf).groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("price"), F.array_sort(F.collect_set("p_name")).alias("names"))


@query(
    "cat_price_merge",
    """WITH o AS (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(n.price, o.price) AS price, CASE WHEN o.price IS NULL THEN 'added' WHEN n.price <> o.price THEN 'updated' ELSE 'kept' END AS change FROM o FULL JOIN n USING (p_partkey)""",
)
def cat_price_merge(spark, sf):
    rows = parts(spark, sf).select("p_partkey", F.col("p_retailprice").alias("price"))
    new = rows.where("p_partkey % 2 = 0").withColumn("price", F.when(F.col("p_partkey") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return C.merged(rows.where("p_partkey % 5 <> 0"), new, ["p_partkey"], "price")


@query("cat_edition_anti", "SELECT DISTINCT p_brand, p_type FROM part p WHERE p_size > 40 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = p.p_brand AND o.p_type = p.p_type AND o.p_size < 2)")
def cat_edition_anti(spark, sf):
    rows = parts(spark, sf)
    return rows.where("p_size > 40").select("p_brand", "p_type").distinct().join(rows.where("p_size < 2").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "left_anti")


@query(
    "cat_options_scope",
    """WITH v AS (SELECT p_brand, unnest(string_split(p_name || ' x' || (p_size % 3), ' ')[2:]) AS value_id, min(p_partkey) AS part FROM part GROUP BY 1, 2)
SELECT p.p_partkey, coalesce(CASE WHEN p.p_size % 10 = 0 THEN p.p_partkey END, v.part) AS scope FROM part p LEFT JOIN v ON p.p_brand = v.p_brand AND split_part(p.p_name, ' ', 2) = v.value_id""",
)
def cat_options_scope(spark, sf):
    rows = parts(spark, sf)
    words = F.split(F.concat("p_name", F.lit(" x"), F.col("p_size") % 3), " ")
    scope = rows.select("p_brand", "p_partkey", F.explode(F.slice(words, F.lit(2), F.size(words))).alias("value_id")).groupBy("p_brand", "value_id").agg(F.min("p_partkey").alias("part"))
    own = F.when(F.col("p_size") % 10 == 0, F.col("p_partkey"))
    asked = rows.withColumn("value_id", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return asked.join(scope, ["p_brand", "value_id"], "left").select("p_partkey", F.coalesce(own, "part").alias("scope"))


@query("cat_matrix_densify", "SELECT a.p_brand, b.p_type, 'missing' AS spec_value FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_type FROM part) b WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size > 48 AND p.p_brand = a.p_brand AND p.p_type = b.p_type)")
def cat_matrix_densify(spark, sf):
    rows = parts(spark, sf)
    big = rows.where("p_size > 48").select("p_brand", "p_type").distinct()
    return C.grid(rows, "p_brand", "p_type").join(big, ["p_brand", "p_type"], "left_anti").withColumn("spec_value", F.lit("missing"))


@query(
    "cat_inherit",
    """WITH s AS (SELECT p_brand AS model, p_type AS edition, min(p_size) AS size FROM part GROUP BY 1, 2), i(child, parent) AS (VALUES ('PREMIUM', 'STANDARD'), ('ECO PLUS', 'ECONOMY'), ('LARGE PLUS', 'LARGE'))
SELECT model, edition, size FROM s UNION ALL SELECT model, child, size FROM s JOIN i ON edition = parent""",
)
def cat_inherit(spark, sf):
    base = parts(spark, sf).groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("edition")).agg(F.min("p_size").alias("size"))
    children = spark.createDataFrame([("PREMIUM", "STANDARD"), ("ECO PLUS", "ECONOMY"), ("LARGE PLUS", "LARGE")], "child string, edition string")
    return base.unionByName(base.join(F.broadcast(children), "edition").select("model", F.col("child").alias("edition"), "size"))


RANGES = (("size", 5, 45), ("price", 950, 1500))


@query(
    "cat_sanity_range",
    "SELECT p_partkey, spec_key, v FROM (SELECT p_partkey, 'size' AS spec_key, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', round(p_retailprice, 2) FROM part) JOIN (VALUES ('size', 5, 45), ('price', 950, 1500)) r(spec_key, lo, hi) USING (spec_key) WHERE v BETWEEN lo AND hi",
)
def cat_sanity_range(spark, sf):
    ranges = spark.createDataFrame(list(RANGES), "spec_key string, lo int, hi int")
    rows = C.attributes(parts(spark, sf)).withColumn("v", F.col("spec_value").try_cast("double"))
    return rows.join(F.broadcast(ranges), "spec_key").where("v BETWEEN lo AND hi").select("p_partkey", "spec_key", "v")


@query("cat_first_dedup", "SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1")
def cat_first_dedup(spark, sf):
    return C.first_of(parts(spark, sf).select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type"], ["p_size", "p_partkey"]).select("p_partkey", "p_brand", "p_type")


@query(
    "cat_color_lookup",
    """SELECT l_returnflag AS color, p_brand, n_name, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, round(greatest(0, max(l_extendedprice) - min(p_retailprice)), 2) AS surcharge
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
)
def cat_color_lookup(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    part = parts(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(F.broadcast(nation), "s_nationkey", "left")
    rows = line.join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left")
    surcharge = F.round(F.greatest(F.lit(0.0), F.max("l_extendedprice") - F.min("p_retailprice")), 2)
    return rows.groupBy(F.col("l_returnflag").alias("color"), "p_brand", "n_name").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), surcharge.alias("surcharge"))


@query("cat_alias_map", "SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'ECO' WHEN 'STANDARD' THEN 'STD' END, p_type) AS edition FROM part")
def cat_alias_map(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("ECONOMY", "ECO", "STANDARD", "STD")])
    return parts(spark, sf).select("p_partkey", F.coalesce(F.element_at(names, F.col("p_type")), "p_type").alias("edition"))


@query("cat_spec_rows", "SELECT spec_key, count(*) AS n, count(DISTINCT spec_value) AS n_values FROM (SELECT 'size' AS spec_key, p_size::VARCHAR AS spec_value FROM part UNION ALL SELECT 'price', p_retailprice::DECIMAL(12, 2)::VARCHAR FROM part UNION ALL SELECT 'name', p_name FROM part) GROUP BY 1")
def cat_spec_rows(spark, sf):
    return C.attributes(parts(spark, sf)).groupBy("spec_key").agg(F.count("*").alias("n"), F.countDistinct("spec_value").alias("n_values"))
