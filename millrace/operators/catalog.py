"""Product catalogue: attribute rows, aliases, inheritance, price merging, sanity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attributes(parts: DataFrame) -> DataFrame:
    """(p_partkey, model, edition, spec_key, spec_value): one row per attribute of a part."""
    cells = "stack(3, 'size', CAST(p_size AS STRING), 'price', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), 'name', p_name) AS (spec_key, spec_value)"
    return parts.select("p_partkey", F.col("p_brand").alias("model"), F.col("p_type").alias("edition"), F.expr(cells))


def longest_alias(rows: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """Each row with the longest alias that its label starts with (ties: the smaller ordinal); null if none.

    Distinct labels are matched, not rows. aliases (alias, target, ord) is a table of rules and is broadcast.
    """
    labels = rows.select(label).distinct()
    best = Window.partitionBy(label).orderBy(F.desc(F.length("alias")), "ord")
    hit = labels.join(F.broadcast(aliases), F.col(label).startswith(F.col("alias")), "left").withColumn("n", F.row_number().over(best)).where("n = 1")
    return rows.join(hit.select(label, "alias", "target"), label, "left")


def merged(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Update where the key is known, insert where it is new; `change` says which."""
    rows = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")), "updated").otherwise("kept")
    return rows.select(*keys, F.coalesce("_new", "_old").alias(value), change.alias("change"))


#: Names of a grid's smaller side that are broadcast.
BROADCAST_NAMES = 1_000_000


def grid(rows: DataFrame, left: str, right: str) -> DataFrame:
    """All combinations of known left and right names. The result is that long; the shorter list of names is broadcast."""
    names = [rows.select(c).where(F.col(c).isNotNull()).distinct() for c in (left, right)]
    sizes = [x.count() for x in names]
    few, many = (0, 1) if sizes[0] <= sizes[1] else (1, 0)
    return names[many].crossJoin(F.broadcast(names[few]) if sizes[few] <= BROADCAST_NAMES else names[few]).select(left, right)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
