import datetime
import time

import pytest
from pyspark.sql import functions as F

from millrace.sources import points, retention
from millrace.sources.publishing import Versions
from millrace.sources.store import Folder

TABLES = ("a", "b")
STEPS = ["intent", "copied a", "copied b", "ready", "switched a", "switched b", "done"]


def versions(spark, root):
    return Versions(spark, str(root), TABLES)


@pytest.mark.parametrize("stop", [None, *STEPS])
def test_a_run_that_dies_between_steps(spark, tmp_path, stop):
    v = versions(spark, tmp_path / "r")
    v.publish("v1", {t: spark.range(3) for t in TABLES})
    steps = v.publishing("v2", {t: spark.range(5) for t in TABLES})
    while stop and next(steps) != stop:
        pass
    steps.close()
    again = versions(spark, tmp_path / "r")  # another process
    early = stop in ("intent", "copied a", "copied b")
    assert again.recover() == ("undone" if early else "consistent" if stop in (None, "done") else "completed")
    assert [again.read(t).count() for t in TABLES] == ([5, 5] if stop and not early else [3, 3])
    assert again.known() == (["v1", "v2"] if stop and not early else ["v1"]) and again.recover() == "consistent"
    if early:
        again.publish("v2", {t: spark.range(7) for t in TABLES})
        assert [again.read(t).count() for t in TABLES] == [7, 7]


def test_readiness_is_checked_against_the_data(spark, tmp_path):
    v = versions(spark, tmp_path / "r")
    v.publish("v1", {t: spark.range(3) for t in TABLES})
    for step in v.publishing("v2", {t: spark.range(5) for t in TABLES}):
        if step == "switched a":
            break
    spark.range(2).write.mode("append").parquet(str(v.folder("v2", "b")))
    assert v.recover() == "undone" and [v.current(t) for t in TABLES] == ["v1", "v1"]


def test_rollback_migration_and_refusals(spark, tmp_path):
    for t in TABLES:
        spark.range(4).write.parquet(str(tmp_path / "old" / t))
    old = {t: str(tmp_path / "old" / t) for t in TABLES}
    before = {k.rsplit("/", 1)[1]: x for t in TABLES for k, x in Folder(spark, old[t]).files().items()}
    v = versions(spark, tmp_path / "r")
    v.migrate("v1", old)
    moved = {k.rsplit("/", 1)[1]: x for t in TABLES for k, x in v.folder("v1", t).files().items()}
    assert moved == before and [v.read(t).count() for t in TABLES] == [4, 4] and not Folder(spark, old["a"]).exists()
    v.migrate("v1", old)  # once more changes nothing
    v.publish("v2", {t: spark.range(6) for t in TABLES})
    assert not v.delete("v2") and v.read("a").count() == 6
    v.rollback("v1")
    assert v.read("b").count() == 4 and v.delete("v2") and v.known() == ["v1"]
    with pytest.raises(ValueError):
        v.rollback("v9")
    with pytest.raises(ValueError):
        v.publish("v1", {})
    next(v.publishing("v3", {}))
    with pytest.raises(RuntimeError):
        v.publish("v4", {})
    assert v.recover() == "undone"
    v._point("a", "v7")
    with pytest.raises(RuntimeError):
        v.recover()


def test_kept_days_are_not_touched(spark):
    rows = spark.createDataFrame([(i, datetime.date(2024, 1, 1 + i % 10) if i % 11 else None) for i in range(200)], "n int, day date").repartition(3)
    spark.sql("DROP TABLE IF EXISTS kept_days")
    retention.save_by_day(rows, "kept_days")
    folder = Folder(spark, spark.sql("DESCRIBE FORMATTED kept_days").where("col_name = 'Location'").first().data_type)
    files = folder.files()
    time.sleep(1.1)
    gone = retention.expire(spark, "kept_days", 4, datetime.date(2024, 1, 10))
    assert gone == [f"2024-01-0{d}" for d in range(1, 6)]
    left = {k: v for k, v in files.items() if not any(f"day={d}" in k for d in gone)}
    assert folder.files() == left and any("DEFAULT_PARTITION" in k for k in left)
    want = rows.where("day >= DATE'2024-01-06' OR day IS NULL").agg(F.sum("n")).first()[0]
    assert spark.table("kept_days").agg(F.sum("n")).first()[0] == want
    assert retention.expire(spark, "kept_days", 4, datetime.date(2024, 1, 10)) == []
    spark.sql("DROP TABLE kept_days")


def test_lookups_read_few_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(0, 100_000).select(F.sha1(F.col("id").cast("string")).alias("id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    points.write(rows, path, "id", 4, 64 << 10, 30_000)
    ids = lambda ns: spark.createDataFrame([(n,) for n in ns], "n long").select(F.sha1(F.col("n").cast("string")).alias("id"))
    asked = [7, 500, 99_999, 42, 43, 44, 45, 46, 47, 48, 49, 50, 100_001]
    found = points.lookup(spark, path, "id", ids(asked))
    assert sorted(r.n for r in found.collect()) == sorted(asked)[:-1]
    assert points.rows_scanned(found) < 20_000
    assert points.rows_scanned(points.lookup(spark, path, "id", ids(range(200_000, 200_006)))) < 3_000  # none is there: Bloom filters say so
    many = points.lookup(spark, path, "id", ids(range(60)), most=50)
    assert many.count() == 60
    assert points.lookup(spark, path, "id", ids([])).count() == 0
