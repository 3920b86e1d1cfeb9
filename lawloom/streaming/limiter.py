"""The limiter over a stream of hits, with the allowed times of a key as its state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.operators.limiter import allow


def limit_stream(hits: DataFrame, key: str, time: str, order: str, *, window: float = 60.0, limit: int = 120) -> DataFrame:
    """(key, order, allowed) for hits in the order in which micro-batches bring them.

    The state of a key holds at most ``limit`` times and goes when the watermark, which lags by the
    window, has passed the key's last window; so memory follows the keys that are active.
    """
    kinds = dict(hits.dtypes)

    def fold(group, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["__t", "__o"], kind="stable")
        allowed = allow(rows["__t"], window, limit, held)
        state.update((list(held),))
        state.setTimeoutTimestamp(max(int((rows["__t"].iloc[-1] + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(rows), order: rows["__o"], "allowed": allowed})

    timed = hits.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{max(1, round(window))} seconds")
    given = timed.select(F.col(time).alias("__at"), F.col(key).alias("__k"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("__t"), F.col(order).alias("__o"))
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean"
    return given.groupBy("__k").applyInPandasWithState(fold, schema, "times array<double>", "append", "EventTimeTimeout")
