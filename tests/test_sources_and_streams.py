import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.plans import runner
from millrace.sources import readers, sinks
from millrace.streaming import folds, ingest, progress

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_pipe_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny", None), ("b", "", "2")], "k string, t string, n string")
    sinks.pipe_csv(rows, str(tmp_path / "c"))
    got = sorted((r.k, r.t, r.n) for r in readers.pipe_csv(spark, str(tmp_path / "c"), ["k", "t", "n"]).collect())
    assert got == [("a", "x y", None), ("b", None, "2")]


def test_chunks_and_rejects(spark, tmp_path):
    good = {"id": "1", "text": "t", "section_path": ["a"], "tags": ["b"], "text_type": "prose", "confidence": 0.5}
    lines = [good, good | {"text": " "}, good | {"tags": []}, good | {"confidence": 2}, good | {"text_type": "poem"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{not json\n")
    valid, rejected = readers.chunks(spark, str(tmp_path / "c.jsonl"))
    assert valid.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["confidence", "no tags", "no text", "not JSON", "text type"]


def test_crawl_files_links_and_sheets(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# source: http://x/y\n# Type: page\n==========\nbody\n# not meta\n")
    row = readers.crawl_files(spark, str(tmp_path / "p.txt")).first()
    assert row.meta == {"source": "http://x/y", "type": "page"} and row.body == "body\n# not meta"
    (tmp_path / "l.txt").write_text("# comment\nManual: https://a/b.pdf\n\n")
    assert [tuple(r) for r in readers.links(spark, str(tmp_path / "l.txt")).collect()] == [("Manual", "https://a/b.pdf")]
    (tmp_path / "s.csv").write_text('﻿ENGINE,,\nPower,"150 kW\n(204 hp)",\nBrakes,,\n')
    got = [(r.label, r.value) for r in readers.spec_sheets(spark, str(tmp_path / "s.csv")).orderBy("row_no").collect()]
    assert got == [("ENGINE", None), ("Power", "150 kW\n(204 hp)"), ("Brakes", None)]


def test_upsert_and_partition_replacement(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "k int, v string, made int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 99)], "k int, v string, made int")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"], ("made",)).collect()) == [(1, "a", 10), (2, "B", 10), (3, "c", 99)]
    twice = spark.createDataFrame([(2, "B", 99, 1), (2, "C", 98, 3), (2, "A", 97, 2), (3, None, 99, 1)], "k int, v string, made int, n int")
    assert sorted(map(str, sinks.upserted(old, twice, ["k"], ("made",), "n").collect())) == sorted(map(str, old.limit(1).collect())) + ["Row(k=2, v='C', made=10)", "Row(k=3, v=None, made=99)"]
    assert sorted(tuple(r) for r in sinks.updated(old, new.select("k", "v"), ["k"]).collect()) == [(1, "a", 10), (2, "B", 10)]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old.withColumn("version", F.col("v")), path, "version")
    sinks.replace_partitions(new.limit(1).withColumn("version", F.lit("b")), path, "version")
    sinks.replace_partitions(new.limit(0).withColumn("version", F.lit("a")), path, "version")
    assert sorted((r.k, r.version) for r in sinks.publish(spark, "current_t", path).collect()) == [(1, "a"), (2, "b")]


def test_stream_into_table_twice_adds_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(EVENTS)
    events.unionByName(events.limit(50)).repartition(4).write.parquet(source)
    for k in (1, 2):
        query = ingest.into_table(ingest.files(spark, source, per_trigger=2), target, str(tmp_path / f"check{k}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(target).count() == events.count()


def test_a_key_on_another_day_or_without_a_time_is_known(spark, tmp_path):
    schema = spark.read.parquet(EVENTS).schema
    day = lambda d: datetime.datetime(2024, 1, d, 5)
    rows = lambda *ids: spark.createDataFrame([(i, d and day(d), 1, "view", 1.0, None) for i, d in ids], schema)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows((1, 1), (2, 2), (3, None), (3, 4)).coalesce(1).write.parquet(source)
    for k, more in enumerate(((), ((1, 9), (2, None), (3, None), (4, 9)))):
        if more:
            rows(*more).coalesce(1).write.mode("append").parquet(source)
        ingest.into_table(ingest.files(spark, source), target, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_id, r.ts) for r in spark.read.parquet(target).collect()) == [(1, day(1)), (2, day(2)), (3, day(4)), (4, day(9))]


def test_progress(spark, tmp_path):
    listener, source = progress.Progress(), str(tmp_path / "in")
    spark.read.parquet(EVENTS).write.parquet(source)
    spark.streams.addListener(listener)
    try:
        query = ingest.files(spark, source).writeStream.format("noop").queryName("watched").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while not listener.figures.get("watched", {}).get("rows") and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.figures["watched"]["rows"] == spark.read.parquet(EVENTS).count() and listener.figures["watched"]["failed"] == 0


def test_eval_cases_counts_and_logs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('test_id,conversation_id,turn_index,user_query,expected_decision,expected_facts,must_not_do\n1,c,0,"a ""q"",\nthen",answer,"[""x"", ""y""]",[]\n2,,1, ,answer,,\n,c,2,q,answer,,\n3,c,3,q,clarify,,not json\n')
    got = readers.eval_cases(spark, str(tmp_path / "c.csv")).orderBy("test_id").collect()
    assert [(r.test_id, r.user_query, r.expected_facts, r.must_not_do) for r in got] == [("1", 'a "q",\nthen', ["x", "y"], []), ("3", "q", [], [])]
    assert readers.row_count(spark, str(tmp_path / "c.csv")) == 4
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "run_id string, n int")
    sinks.json_log(log, str(tmp_path / "l"), "a")
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "l")).collect()) == [1, 3]
    sinks.json_log(log, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 3


def test_publish_in_the_catalogue(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "v1"))
    spark.range(4).write.parquet(str(tmp_path / "v2"))
    try:
        for v, n in (("v1", 3), ("v2", 4)):
            sinks.publish(spark, "published_t", str(tmp_path / v), catalog=True)
            assert spark.newSession().table("published_t").count() == n
    finally:
        spark.sql("DROP VIEW IF EXISTS published_t")


def test_runner():
    done = []
    step = lambda name, out=None: (name, lambda: done.append(name) or out)
    report = runner.run([step("a"), step("b", True)], lambda: True, lambda: done.append("publish"))
    assert report.passed and report.published and done == ["a", "b", "publish"]
    report = runner.run([step("c", False), step("d")], lambda: True, lambda: done.append("never"))
    assert not report.passed and not report.published and done[-1] == "c"
    report = runner.run([step("e")], lambda: False, lambda: done.append("never"))
    assert [s for s, *_ in report.steps] == ["e", "gate"] and not report.published and "never" not in done
    with pytest.raises(ValueError):
        runner.run([("f", lambda: int("x"))])


def test_hourly_stream_as_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(EVENTS)
    events.write.parquet(source)
    rows = ingest.hourly(ingest.deduplicated(ingest.files(spark, source)))
    query = rows.writeStream.format("memory").queryName("hourly").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy(F.date_trunc("hour", "ts").alias("h")).count()
    streamed = {r.window.start: r.requests for r in spark.table("hourly").collect()}
    assert streamed and all(streamed[r.h] == r["count"] for r in batch.collect() if r.h in streamed)


def test_token_bucket_stream_as_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.read.parquet(EVENTS).select(F.concat(F.lit("ip"), F.col("user_id") % 3).alias("client_ip"), "event_id", (F.col("event_id") * 700).alias("at_ms"))
    rows.repartition(1).write.parquet(source)
    stream = folds.stream(spark.readStream.schema(rows.schema).parquet(source), "client_ip", folds.token_bucket, folds.BUCKET_OUT, folds.BUCKET_STATE)
    query = stream.writeStream.format("memory").queryName("bucket").outputMode("append").start()
    try:
        until = time.time() + 60  # timeouts keep such a query running after its last data
        while spark.table("bucket").count() < rows.count() and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    want = {r.event_id: r.allowed for r in folds.batch(rows, "client_ip", folds.token_bucket, folds.BUCKET_OUT).collect()}
    assert {r.event_id: r.allowed for r in spark.table("bucket").collect()} == want and False in want.values()
