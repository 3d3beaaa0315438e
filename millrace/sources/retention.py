"""Retention of tables partitioned by day: expired days are dropped as partitions, files of kept days aren't touched."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

#: Partitions that one statement drops.
AT_ONCE = 500


def save_by_day(rows: DataFrame, name: str, day: str = "day") -> None:
    """A table of the catalogue with a partition per day."""
    rows.write.partitionBy(day).format("parquet").saveAsTable(name)


def days(spark: SparkSession, name: str, day: str = "day") -> list[str]:
    """The days that the catalogue knows; rows without a day are none."""
    found = [dict(p.split("=", 1) for p in r.partition.split("/")).get(day) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    return sorted(d for d in found if d and not d.startswith("__"))


def expire(spark: SparkSession, name: str, keep_days: int, as_of: datetime.date, day: str = "day") -> list[str]:
    """Drops the days that lie more than keep_days before as_of; returns them. Rows without a day stay."""
    first = (as_of - datetime.timedelta(days=keep_days)).isoformat()
    gone = [d for d in days(spark, name, day) if d < first]
    for k in range(0, len(gone), AT_ONCE):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION ({day} = '{d}')" for d in gone[k : k + AT_ONCE]))
    return gone
