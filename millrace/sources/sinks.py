"""Writers: partitioned tables, delimited files, JSON lines, keyed upserts, partition replacement, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pipe_csv(rows: DataFrame, path: str) -> None:
    """Null becomes empty; line breaks inside fields become spaces."""
    rows.select([F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit("")).alias(c) for c in rows.columns]).write.mode("overwrite").option("header", True).option("sep", "|").option("emptyValue", "").csv(path)


def json_lines(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").partitionBy(by).json(path)


def json_log(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Log entries as JSON lines, of one run if it is named."""
    rows = rows if run is None else rows.where(F.col("run_id") == run)
    rows.write.mode("overwrite").json(path)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the one with the greatest order (of those that tie, the greatest of the other columns)."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """new over old by key; the columns in `keep` stay as they were where the key was known.

    order: a column of new that isn't one of old's; of new rows that repeat a key the one with the greatest counts. Without it keys of new mustn't repeat.
    """
    fresh = new if order is None else last_of(new, keys, order)
    was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_known"))
    changed = fresh.join(was, keys, "left").select(*[F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(changed)


def updated(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's columns where new has the key; keys that only new has add nothing."""
    columns = [c for c in new.columns if c not in keys]
    named = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    rows = old.join(named, keys, "left")
    return rows.select(*[F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Only partitions that rows has are overwritten; without rows nothing changes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish(spark: SparkSession, name: str, path: str, catalog: bool = False) -> DataFrame:
    """Points a name at a finished version; readers see the old one or the new one.

    catalog: as a view of the catalogue, which every session that shares it sees; else of this session only.
    """
    rows = spark.read.parquet(path)
    if catalog:
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    else:
        rows.createOrReplaceTempView(name)
    return rows
