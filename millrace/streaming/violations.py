"""Rate-limit violations as a stream: a value state per address, and timers that forget idle ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import CRITICAL_VIOLATIONS

OUT = "request_id string, client_ip string, violations long, severity string"
#: The state store that such processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Violations(StatefulProcessor):
    """Counts an address's limited requests over all batches; an address without one for `forget_ms` of event time counts anew."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["created_at", "event_id"])
        n = self.count.get()[0] if self.count.exists() else 0
        counts = range(n + 1, n + 1 + len(new))
        self.count.update((n + len(new),))
        if self.forget_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            latest = max(int(new["created_at"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(latest + self.forget_ms)
        yield pd.DataFrame({"request_id": new["request_id"], "client_ip": new["client_ip"], "violations": list(counts), "severity": ["CRITICAL" if x >= CRITICAL_VIOLATIONS else "WARNING" for x in counts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def violations(limited: DataFrame, forget_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """The running count of limited requests (request_id, client_ip, event_id, created_at) per address, in the order of batches and in time order within them.

    With forget_ms timers run on event time; the session must use the ROCKS state store.
    """
    rows = limited.select("request_id", "client_ip", "event_id", limited["created_at"].cast("timestamp").alias("created_at"))
    if forget_ms is not None:
        rows = rows.withWatermark("created_at", delay)
    return rows.groupBy("client_ip").transformWithStateInPandas(Violations(forget_ms), OUT, "Append", "None" if forget_ms is None else "EventTime")
