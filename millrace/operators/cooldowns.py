"""A cooldown over events in three steps, so that a key with most events is as many tasks as it has segments of time.

Whether an event is let through depends on the last one that was. Within a segment that last one matters only by the time
from which events are let through again, and of such times only those within a cooldown of the segment's begin: each
segment says where a run that enters at each of them ends. These short tables are folded in time order per key; then
every segment knows where it is entered, and marks its own events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import folds

#: Milliseconds of a segment.
SEGMENT_MS = 3_600_000


def _runs(times: np.ndarray, pause: int) -> np.ndarray:
    """The last time let through of a run that begins at each of the sorted distinct times."""
    after = np.searchsorted(times, times + pause)
    at = np.arange(len(times))
    while True:
        more = after[at] < len(times)
        if not more.any():
            return times[at]
        at[more] = after[at[more]]


def _ways(pause: int, segment: int):
    def ways(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(rows["at_ms"].to_numpy())
        last = _runs(times, pause)
        entered = np.append(True, times[:-1] < key[1] * segment + pause)  # someone can begin at it
        times, last = times[entered], last[entered]
        ends = np.append(last[1:] != last[:-1], True)
        return pd.DataFrame({"key": [key[0]], "event_id": [key[1]], "at_ms": [key[1]], "upto": [times[ends]], "last": [last[ends]]})

    return ways


def _entered(pause: int):
    def entered(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, out = (state[0] if state else None), []
        for upto, lasts in zip(rows["upto"], rows["last"]):
            free = None if last is None else last + pause
            out.append(free)
            k = 0 if free is None else int(np.searchsorted(upto, free))
            if k < len(upto):
                last = int(lasts[k])
        return (last,), rows[["key", "event_id"]].assign(free=pd.array(out, dtype="Int64"))

    return entered


def _marked(pause: int):
    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "event_id"]).reset_index(drop=True)
        times = rows["at_ms"].to_numpy()
        free = rows["free"].iloc[0]
        at = 0 if pd.isna(free) else int(np.searchsorted(times, int(free)))
        notify = np.zeros(len(rows), bool)
        while at < len(times):
            notify[at] = True
            at = int(np.searchsorted(times, times[at] + pause))
        return rows[["key", "event_id", "at_ms"]].assign(notify=notify)

    return mark


def cooldown(events: DataFrame, key: str, pause_ms: int = 1000 * folds.COOLDOWN_S, segment_ms: int = SEGMENT_MS) -> DataFrame:
    """(key, event_id, at_ms, notify) of events: the first of a key is let through, and each that comes pause_ms or more after the last one that was."""
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "event_id", "at_ms", F.floor(F.col("at_ms") / segment_ms).cast("long").alias("segment"))
    kind = dict(rows.dtypes)["key"]
    ways = rows.select("key", "segment", "at_ms").distinct().groupBy("key", "segment").applyInPandas(_ways(pause_ms, segment_ms), f"key {kind}, event_id long, at_ms long, upto array<long>, last array<long>")
    entered = folds.batch(ways, "key", _entered(pause_ms), f"key {kind}, event_id long, free long").withColumnRenamed("event_id", "segment")
    made = rows.join(entered, ["key", "segment"]).groupBy("key", "segment").applyInPandas(_marked(pause_ms), f"key {kind}, event_id long, at_ms long, notify boolean")
    return made.withColumnRenamed("key", key)
