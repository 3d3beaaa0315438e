"""Messages by topic: a log in files as a streaming source, and a consumer that routes them.

The log has a folder per topic and a file of JSON lines per partition; its columns and offsets are those of
Kafka's source, so that what reads one reads the other, and a test needs no broker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "topic string, partition int, offset long, value string"
#: Lines of a partition that one task reads.
PER_TASK = 100_000


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, topic: str, partition: int, start: int, end: int):
        self.topic, self.partition, self.start, self.end = topic, partition, start, end


class _Log:
    def __init__(self, options: dict):
        self.path, self.topics = options["path"], [t for t in options.get("subscribe", "").split(",") if t]

    def ends(self) -> dict[str, int]:
        """Lines written so far, by "topic/partition"; a last line without its end isn't there yet."""
        fs, root = _filesystem(self.path)
        out = {}
        for topic in self.topics:
            for f in fs.get_file_info(pafs.FileSelector(f"{root}/{topic}", allow_not_found=True)):
                if f.base_name.endswith(".jsonl"):
                    with fs.open_input_stream(f.path) as s:
                        n = 0
                        while chunk := s.read(1 << 20):
                            n += chunk.count(b"\n")
                    out[f"{topic}/{f.base_name[:-6]}"] = n
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for key in sorted(end):
            topic, partition = key.rsplit("/", 1)
            first, last = start.get(key, 0), end[key]
            out += [Range(topic, int(partition), a, min(a + PER_TASK, last)) for a in range(first, last, PER_TASK)]
        return out

    def lines(self, part: Range) -> Iterator[tuple]:
        fs, root = _filesystem(self.path)
        with fs.open_input_stream(f"{root}/{part.topic}/{part.partition}.jsonl") as s:
            rest, n = b"", 0
            while n < part.end and (chunk := s.read(1 << 20)):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    if part.start <= n < part.end:
                        yield part.topic, part.partition, n, line.decode("utf-8", "replace")
                    n += 1


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = _Log(options)
        starting = options.get("startingoffsets", "earliest")
        self.first = self.log.ends() if starting == "latest" else {} if starting == "earliest" else {f"{t}/{p}": n for t, by in json.loads(starting).items() for p, n in by.items()}

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.log.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.log.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[Range]:
        return self.log.ranges({}, self.log.ends()) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.log.lines(partition) if partition.end else iter(())


class TopicLog(DataSource):
    """format("topiclog"): path; subscribe, topics by comma; startingOffsets, "earliest", "latest" or {topic: {partition: offset}}."""

    @classmethod
    def name(cls) -> str:
        return "topiclog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def log(spark: SparkSession, path: str, topics: str, starting: str = "earliest") -> DataFrame:
    """The log as a stream."""
    spark.dataSource.register(TopicLog)
    return spark.readStream.format("topiclog").option("path", path).option("subscribe", topics).option("startingOffsets", starting).load()


def append(path: str, topic: str, partition: int, messages: list) -> None:
    """Messages at the end of a partition of the log: for tests and small tools. Values that aren't text are written as JSON."""
    fs, root = _filesystem(path)
    fs.create_dir(f"{root}/{topic}", recursive=True)
    with fs.open_append_stream(f"{root}/{topic}/{partition}.jsonl") as s:
        s.write("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages).encode())


def broker(spark: SparkSession, servers: str, topics: str, least: int = 20, wait: str = "2s", most: int = 10_000, starting: str = "latest") -> DataFrame:
    """The same columns from Kafka (needs Spark's package for it): a batch once `least` messages are there, or after `wait`."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics, "minOffsetsPerTrigger": least, "maxTriggerDelay": wait, "maxOffsetsPerTrigger": most, "startingOffsets": starting}
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def consumer(messages: DataFrame, routes: dict[str, tuple[str, str, str]], rejects: str, checkpoint: str):
    """A writer that adds each topic's messages to its table; routes: {topic: (schema, key, path)}.

    A key that the table has is skipped, of keys that repeat the earliest counts (by partition and offset), and what
    isn't an object of the schema with a key goes to `rejects` as it came. A batch that is run again adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        spark = batch.sparkSession
        place = ["topic", "partition", "offset"]
        bad = []
        for topic, (schema, key, path) in routes.items():
            rows = batch.where(F.col("topic") == topic).withColumn("e", F.from_json("value", schema))
            bad.append(rows.where(F.col(f"e.{key}").isNull()).select(*place, "value"))
            first = rows.where(F.col(f"e.{key}").isNotNull()).groupBy(F.col(f"e.{key}").alias("_key")).agg(F.min(F.struct("partition", "offset", "e")).alias("_m"))
            new = first.select("_m.e.*")
            known = _table(spark, path)
            (new if known is None else new.join(known.select(key), key, "left_anti")).select(*_names(schema)).write.mode("append").parquet(path)
        bad.append(batch.where(~F.col("topic").isin(*routes)).select(*place, "value"))
        refused = bad[0]
        for b in bad[1:]:
            refused = refused.unionByName(b)
        known = _table(spark, rejects)
        (refused if known is None else refused.join(known.select(*place), place, "left_anti")).write.mode("append").parquet(rejects)
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
