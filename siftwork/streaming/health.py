"""Streaming source health and snapshot chains: keyed state over attempt and capture streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STABLE = ("ok", "degraded", "blocked")


def health_updates(attempts: DataFrame) -> DataFrame:
    """Per batch and source its state after all attempts so far. Input stream: source_id, seq, outcome, error.
    State per source: last attempt, last stable state, its error, number of attempts."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_seq, status, stable, error, n = state.get if state.exists else (-1, "ready", "ready", None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples(index=False):
            n += 1
            if r.seq <= last_seq:
                continue  # a late row of a state that is already newer
            last_seq = r.seq
            if r.outcome in STABLE:
                stable, error = r.outcome, None if r.outcome == "ok" else r.error
                status = stable
            else:
                status = "running" if r.outcome == "running" else stable
        state.update((last_seq, status, stable, error, n))
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "error": [error], "attempts": [n]})

    return attempts.groupBy("source_id").applyInPandasWithState(fold, "source_id string, status string, error string, attempts long", "last_seq long, status string, stable string, error string, attempts long", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, ts: str, window: str, late: str, *keys: str) -> DataFrame:
    """Tumbling-window counts; rows later than `late` behind the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
