"""Rows by id: files sorted by it, with Bloom filters, of which a lookup reads the few row groups that may have one of its ids."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a lookup that become part of the scan's filter; more are joined.
MOST_IDS = 2_000
#: So many ids are pushed down as equalities; of a longer list Spark's reader gets only the least and the greatest.
TOGETHER = 10


def write(rows: DataFrame, path: str, key: str, files: int, group_bytes: int = 16 << 20, per_file: int = 1_000_000) -> None:
    """`files` files in ranges of the key; per_file: about how many different keys each has."""
    ranged = rows.repartitionByRange(files, key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(per_file), "parquet.block.size": str(group_bytes)}
    ranged.write.options(**options).parquet(path)


def among(key: str, ids: list) -> Column:
    parts = [F.col(key).isin(ids[k : k + TOGETHER]) for k in range(0, len(ids), TOGETHER)]
    return functools.reduce(operator.or_, parts, F.lit(False))


def lookup(spark: SparkSession, path: str, key: str, ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """The rows whose key is among ids (a table with the key): within `most` of them by filter, else by a semi join."""
    rows = spark.read.parquet(path)
    found = ids.select(key).where(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in found.limit(most + 1).collect()]
    return rows.where(among(key, sorted(some))) if len(some) <= most else rows.join(found, key, "left_semi")


def rows_scanned(df: DataFrame) -> int:
    """Runs df's scans and counts the rows that they read from files."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size()))
