import random

import pytest

from millrace.operators.cooldowns import cooldown
from millrace.streaming import folds


@pytest.mark.parametrize("segment,gap", [(3_600_000, 100_000), (600_000, 400_000), (900_000, 20_000), (10_000_000, 700_000)])
def test_as_the_fold_in_time_order(spark, segment, gap):
    r = random.Random(segment)
    rows, at = [], {k: r.randrange(-5_000_000, 5_000_000) for k in "abc"}
    for i in range(400):
        k = r.choice("aab")
        at[k] += r.choice([0, r.randrange(gap), 600_000, 599_999, 0])
        rows.append((k, r.randrange(10**6), at[k]))
    rows += [("c", 1, 5), (None, 2, 5)]
    frame = spark.createDataFrame(rows, "alert_type string, event_id long, at_ms long").repartition(3)
    want = sorted(tuple(x) for x in folds.batch(frame, "alert_type", folds.cooldown, folds.COOLDOWN_OUT).collect())
    assert sorted(tuple(x) for x in cooldown(frame, "alert_type", segment_ms=segment).collect()) == want


def test_no_events(spark):
    frame = spark.createDataFrame([], "alert_type string, event_id long, at_ms long")
    assert cooldown(frame, "alert_type").columns == ["alert_type", "event_id", "at_ms", "notify"] and cooldown(frame, "alert_type").collect() == []
