"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: u's greater neighbours go to its least one; small: u and its lesser ones do."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    told = near.join(least, "u")
    out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else told.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b); the component is the least id that can be reached.

    Only tables of links are shuffled, keyed by one end; every round is written to the shared folder.
    """
    edges = common.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        edges = common.cut(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
