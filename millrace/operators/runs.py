"""Running values along an order, in two levels: per bucket of the order, then within buckets.

A group's rows are dealt into buckets of its order (ranges of an integer key, or minutes). Only one row
per group and bucket meets in a window over the whole group, and rows are sorted within buckets, so a
group that holds most rows is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Integer keys per bucket.
WIDTH = 65_536


def by_range(key: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(key) / width).cast("long")


def _so_far(*by: str):
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(rows: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their group up to them. Groups are compared null-safe; a null bucket comes last."""
    marked = rows.withColumns({"_bucket": bucket, "_value": value})
    sums = marked.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = F.sum("_value").over(_so_far(*by, "_bucket").orderBy(*order))
    return marked.withColumn("_inner", inner).join(offsets, on).withColumn(name, F.col("_before") + F.col("_inner")).drop("_bucket", "_value", "_inner", "_before", "_b", *[f"_{c}" for c in by])


def numbered(rows: DataFrame, by: list[str], key: str, name: str = "seq") -> DataFrame:
    """Sequence numbers within groups along an integer key."""
    return running_sum(rows, by, by_range(key), [key], F.lit(1), name)


def filled_forward(rows: DataFrame, by: list[str], key: str, column: str) -> DataFrame:
    """Nulls of a column take the latest value before them in their group, along an integer key."""
    marked = rows.withColumn("_bucket", by_range(key))
    last = marked.where(F.col(column).isNotNull()).groupBy(*by, "_bucket").agg(F.max_by(column, key).alias("_last"))
    ends = marked.select(*by, "_bucket").distinct().join(last, [*by, "_bucket"], "left")
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inner = F.last(column, ignorenulls=True).over(_so_far(*by, "_bucket").orderBy(key))
    return marked.withColumn(column, inner).join(carried, [*by, "_bucket"]).withColumn(column, F.coalesce(column, "_carried")).drop("_bucket", "_carried")
