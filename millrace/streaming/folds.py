"""Ordered folds with state per key: the same function serves batches and streams.

A fold takes (state, rows of one key in time order) and returns (state, output rows). State is a
flat tuple, so that it fits a streaming state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY, PER_MINUTE, COOLDOWN_S, IDLE_MS = 5.0, 30.0, 600, 600_000

BUCKET_OUT = "client_ip string, event_id long, at_ms long, allowed boolean, retry_after_s double"
BUCKET_STATE = "tokens double, at_ms long"
COOLDOWN_OUT = "alert_type string, event_id long, at_ms long, notify boolean"
COOLDOWN_STATE = "sent_ms long"


def token_bucket(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Each request takes a token of its address; tokens come back with time, up to the capacity."""
    tokens, last = state or (CAPACITY, None)
    allowed, retry = [], []
    for at in rows["at_ms"].tolist():
        if last is not None:
            tokens = min(CAPACITY, tokens + max(0, at - last) * PER_MINUTE / 60_000)
        last = at
        ok = tokens >= 1
        tokens -= ok
        allowed.append(ok)
        retry.append(0.0 if ok else round((1 - tokens) * 60 / PER_MINUTE, 3))
    return (tokens, last), rows[["client_ip", "event_id", "at_ms"]].assign(allowed=allowed, retry_after_s=retry)


def cooldown(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """An alert is sent if its type had none sent for so many seconds; the first always is."""
    sent = state[0] if state else None
    notify = []
    for at in rows["at_ms"].tolist():
        ok = sent is None or at - sent >= COOLDOWN_S * 1000
        sent = at if ok else sent
        notify.append(ok)
    return (sent,), rows[["alert_type", "event_id", "at_ms"]].assign(notify=notify)


CARRIED_OUT = "conv_id long, event_id long, at_ms long, model string, edition string, topic string"
CARRIED_STATE = "model string, edition string, topic string"


def carried(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """What a conversation's turns say of model, edition and topic; a turn that says nothing of one takes what was said last."""
    held, out = list(state or (None, None, None)), []
    for said in zip(rows["model"].tolist(), rows["edition"].tolist(), rows["topic"].tolist()):
        held = [new if isinstance(new, str) else old for new, old in zip(said, held)]
        out.append(held)
    columns = dict(zip(("model", "edition", "topic"), zip(*out)))
    return tuple(held), rows[["conv_id", "event_id", "at_ms"]].assign(**columns)


def batch(rows: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """The fold over all rows of each key. Keys come in time order, in bounded Arrow batches, with state between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, open_key = None, None
        for b in batches:
            new = b[key] != b[key].shift()
            for _, part in b.groupby(new.cumsum(), sort=False):
                k = part[key].iloc[0]
                state, open_key = (state if k == open_key else None), k
                state, out = fold(state, part)
                yield out

    return rows.where(f"{key} IS NOT NULL").repartition(key).sortWithinPartitions(key, "at_ms", "event_id").mapInPandas(run, schema)


def stream(rows: DataFrame, key: str, fold, schema: str, state_schema: str) -> DataFrame:
    """The fold over a stream of (key, event_id, at_ms, at); keys idle for a while are forgotten."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(batches)
        got = pd.concat(parts).sort_values(["at_ms", "event_id"])
        new, out = fold(tuple(state.get) if state.exists else None, got)
        state.update(new)
        state.setTimeoutDuration(IDLE_MS)
        yield out

    return rows.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)
