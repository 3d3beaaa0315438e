import datetime

from millrace.plans import telemetry as P


def test_open_requests_by_the_microsecond(spark, tmp_path):
    """A request that ends within the millisecond in which another begins, but after that, is still open."""
    at = lambda us: datetime.datetime(2024, 1, 5, 10, 0, 0, us)
    rows = [(1, at(900), 1, "view", 12.3, "{}"), (2, at(123_500), 1, "view", 10.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.most_open for r in P.tel_max_overlap(spark, str(tmp_path)).collect()] == [2]


def test_requests_without_an_end_stay_open(spark, tmp_path):
    rows = [(n, datetime.datetime(2024, 1, 5 + n, 10), 1, "view", v, "{}") for n, v in ((1, None), (2, 5.0))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {str(r.day): r.most_open for r in P.tel_max_overlap(spark, str(tmp_path)).collect()} == {"2024-01-06": 1, "2024-01-07": 2, "None": 1}
