import datetime

from pyspark.sql import functions as F

from millrace.operators import telemetry as T
from millrace.streaming import topics
from millrace.streaming.violations import ROCKS, violations

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()


def test_violations_in_several_batches_as_in_one(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = spark.read.parquet(EVENTS).withColumn("user_id", F.col("user_id") % 3)
    facts = T.metrics(events)
    ordered = events.orderBy("ts", "event_id").collect()
    size = -(-len(ordered) // 4)
    for k in range(4):
        spark.createDataFrame(ordered[k * size : (k + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = violations(T.metrics(stream).where("status_code = 429"))
    run(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")))
    want = sorted((r.request_id, r.client_ip, r.violations, r.severity) for r in T.violations(facts).collect())
    assert sorted((r.request_id, r.client_ip, r.violations, r.severity) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert {s for *_, s in want} == {"WARNING", "CRITICAL"}


def test_idle_addresses_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "request_id string, client_ip string, event_id long, created_at timestamp"
    for k, batch in enumerate([[("a", 0), ("b", 1), ("a", 2)], [("b", 20)], [("b", 21)], [("a", 22), ("b", 23)]]):
        spark.createDataFrame([(f"{k}{ip}{m}", ip, m, at(m)) for ip, m in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(violations(stream, forget_ms=600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")))
    got = {r.request_id: r.violations for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got["0a0"], got["0a2"], got["0b1"], got["3a22"]) == (1, 2, 1, 1)  # a was idle for 20 minutes
    assert got["2b21"] == got["1b20"] + 1 and got["3b23"] == got["2b21"] + 1


METRIC, ALERT = "request_id string, n long", "alert_id string, severity string"


def routes(tmp_path):
    return {"metrics": (METRIC, "request_id", str(tmp_path / "metrics")), "alerts": (ALERT, "alert_id", str(tmp_path / "alerts"))}


def test_messages_are_routed_by_topic_and_replayed(spark, tmp_path):
    log = str(tmp_path / "log")
    topics.append(log, "metrics", 0, [{"request_id": "r1", "n": 1}, {"request_id": "r2", "n": 2}, "not json", {"n": 5}])
    topics.append(log, "metrics", 1, [{"request_id": "r1", "n": 9}, {"request_id": "r3", "n": 3}])
    topics.append(log, "alerts", 0, [{"alert_id": "a1", "severity": "CRITICAL", "more": 1}])
    topics.append(log, "noise", 0, [{"x": 1}])

    def consume(check, starting="earliest"):
        run(topics.consumer(topics.log(spark, log, "metrics,alerts,noise", starting), routes(tmp_path), str(tmp_path / "rejects"), str(tmp_path / check)))
        tables = [spark.read.parquet(str(tmp_path / t)).collect() for t in ("metrics", "alerts", "rejects")]
        return [sorted((r.request_id, r.n) for r in tables[0]), sorted((r.alert_id, r.severity) for r in tables[1]), sorted((r.topic, r.partition, r.offset, r.value) for r in tables[2])]

    first = consume("c1")
    assert first == [[("r1", 1), ("r2", 2), ("r3", 3)], [("a1", "CRITICAL")], [("metrics", 0, 2, "not json"), ("metrics", 0, 3, '{"n": 5}'), ("noise", 0, 0, '{"x": 1}')]]
    topics.append(log, "metrics", 1, [{"request_id": "r4", "n": 4}])
    topics.append(log, "metrics", 2, [{"request_id": "r5", "n": 5}])
    second = consume("c1")  # goes on where it was
    assert second[0] == [*first[0], ("r4", 4), ("r5", 5)] and second[1:] == first[1:]
    assert consume("c2") == second  # all over again adds nothing
    assert consume("c3", '{"metrics": {"1": 2}}') == second


def test_a_replay_begins_at_its_offsets(spark, tmp_path):
    log = str(tmp_path / "log")
    topics.append(log, "metrics", 0, [{"request_id": f"r{i}", "n": i} for i in range(9)])
    topics.append(log, "alerts", 0, [{"alert_id": "a"}])
    rows = topics.log(spark, log, "metrics,alerts", '{"metrics": {"0": 6}, "alerts": {"0": 1}}')
    run(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")))
    assert sorted((r.topic, r.offset) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("metrics", 6), ("metrics", 7), ("metrics", 8)]
    assert spark.read.format("topiclog").option("path", log).option("subscribe", "metrics").load().count() == 9
