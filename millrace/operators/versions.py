"""Versioned tables: what is current, what replaces what, what is cached and what is orphaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(rows: DataFrame, registry: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the current version; the registry is a table of a few versions."""
    return rows.join(F.broadcast(registry.where("is_current").select(version)), version, "left_semi")


def with_current(registry: DataFrame, version: str, now: str) -> DataFrame:
    """The registry with another current version; the one before is marked as rolled back."""
    chosen = F.col("version") == version
    stamp = F.lit(now).cast("timestamp_ntz")
    return registry.withColumns(
        {
            "activated_at": F.when(chosen, stamp).otherwise(F.col("activated_at")),
            "rolled_back_at": F.when(F.col("is_current") & ~chosen, stamp).otherwise(F.col("rolled_back_at")),
            "is_current": chosen,
        }
    )


def replaced(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Partitions that new has come from new, all others stay; an empty new changes nothing."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with a `hit` flag: whether the cache has their content hash."""
    return rows.join(cache.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def orphans(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return existing.join(wanted.select(key), key, "left_anti")


def may_delete(registry: DataFrame, version: Column) -> DataFrame:
    """Whether each version may go: not if it is current."""
    return registry.select(version.alias("version"), (~F.col("is_current")).alias("may_delete"))
