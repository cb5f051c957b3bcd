"""The rate limiter as a streaming operator with state for each key.

Within a micro-batch a key's events are taken in order of time. A late event is admitted or refused in the window that
is open when it arrives. State of a key ends when its window has been over for ``idle_ms`` of processing time.

A task holds all times of one key in a micro-batch, as they have to be sorted. Nothing here bounds them: where a key may
have many, bound the micro-batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit_stream(events: DataFrame, key: str, time_ms: str, most: int = 100, window_ms: int = 60_000, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, time_ms, allowed, remaining) of a stream of requests."""

    def admit(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (-1, 0)
        rows = pd.concat([*batches]).sort_values(time_ms, kind="stable")
        allowed, remaining = [], []
        for at in rows[time_ms]:
            if opened < 0 or at - opened >= window_ms:
                opened, used = int(at), 0
            allowed.append(used < most)
            used += allowed[-1]
            remaining.append(most - used)
        state.update((opened, used))
        state.setTimeoutDuration(idle_ms)
        yield rows[[key, time_ms]].assign(allowed=allowed, remaining=remaining)

    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, time_ms)) + ", allowed boolean, remaining long"
    return (
        events.select(key, time_ms)
        .groupBy(key)
        .applyInPandasWithState(admit, schema, "opened long, used long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
