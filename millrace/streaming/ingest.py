"""Request events as a stream: parsing, routing, deduplication, an idempotent table, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def files(spark: SparkSession, path: str, schema: T.StructType = EVENT, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def kafka(spark: SparkSession, servers: str, topics: str, per_trigger: int = 10_000) -> DataFrame:
    """(topic, event...) of JSON messages; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select("topic", F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("topic", "e.*")


def deduplicated(events: DataFrame, delay: str = "1 hour", key: str = "event_id") -> DataFrame:
    """One row per key within the delay; needs a timestamp with time zone as event time."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, delay: str = "1 hour", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window; rows later than the delay don't count."""
    at = events if "at" in events.columns else events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return at.groupBy(F.window("at", length, slide)).agg(F.count("*").alias("requests"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return at.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("requests"))


def into_table(rows: DataFrame, path: str, checkpoint: str, key: str = "event_id", day: str = "ts"):
    """Appends rows whose key the table lacks, on any day, partitioned by day; a batch that is written again adds nothing.

    One writer per table. Of rows that repeat a key the earliest counts, and rows without a time lie in a day of their own.
    Only the key column of the table is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in (key, day)]
        first = batch.groupBy(key).agg(F.min(F.struct(F.col(day).isNull().alias("_late"), F.col(day), *others)).alias("_r"))
        rows = first.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in batch.columns]).withColumn("day", F.to_date(day))
        try:
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").partitionBy("day").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
