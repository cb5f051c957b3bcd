"""Per-key recurrences over ordered events, and the roll-ups around them.

A rate limiter's windows start at a key's own requests and a breaker's state depends on all events before, so neither is
a window function. Rows are partitioned by key and sorted; one pass over a partition carries the state of one key at a
time, so a key with very many events takes time but no memory. Ties in time are broken by the event id; null keys are a
key of their own; null times come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.text import utrim

#: Statuses of a health check by severity.
SEVERITY = ("healthy", "degraded", "unhealthy")


def fold_by_key(df: DataFrame, key: str, order: list[str], extra: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Run ``step(state, *order and extra values) -> (state, result tuple)`` over each key's rows in order.

    The result has the key, the ``order`` columns and what ``step`` gives, as in ``schema``.
    """
    names = [f.name for f in T.StructType.fromDDL(schema)]
    columns = [key, *order, *extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, types = object(), None, None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(1 + len(order))]
            out: list[list] = [[] for _ in names]
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if row[0] != current:
                    current, state = row[0], start()
                state, result = step(state, *row[1:])
                for column, value in zip(out, (*row[: 1 + len(order)], *result), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[i]) if i < len(types) else pa.array(c) for i, c in enumerate(out)], names=names)

    by_key = df.select(*columns).repartition(key).sortWithinPartitions(key, *order)
    return by_key.mapInArrow(run, schema)


def _schema(df: DataFrame, columns: list[str]) -> str:
    """DDL of the columns, with the types that ``df`` has."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def rate_limit(events: DataFrame, key: str, time_ms: str, event_id: str, most: int = 100, window_ms: int = 60_000) -> DataFrame:
    """(key, time_ms, event_id, allowed, remaining): fixed windows that start at a key's first request after the last."""

    def step(state, at, _):
        opened, used = state
        if opened is None or at - opened >= window_ms:
            opened, used = at, 0
        allowed = used < most
        used += allowed
        return (opened, used), (allowed, most - used)

    return fold_by_key(events, key, [time_ms, event_id], [], lambda: (None, 0), step, _schema(events, [key, time_ms, event_id]) + ", allowed boolean, remaining long")


def circuit_breaker(events: DataFrame, key: str, time_ms: str, event_id: str, failed: str, failures: int = 5, reset_ms: int = 30_000) -> DataFrame:
    """(key, time_ms, event_id, admitted, state): open after consecutive failures, half-open once the reset time is over."""

    def step(state, at, _, is_failure):
        name, count, opened = state
        if name == "open" and at - opened >= reset_ms:
            name = "half-open"
        admitted = name != "open"
        if admitted and is_failure:
            count += 1
            if name == "half-open" or count >= failures:
                name, opened = "open", at
        elif admitted:
            name, count = "closed", 0
        return (name, count, opened), (admitted, name)

    return fold_by_key(events, key, [time_ms, event_id], [failed], lambda: ("closed", 0, 0), step, _schema(events, [key, time_ms, event_id]) + ", admitted boolean, state string")


def admission(requests: DataFrame, decisions: DataFrame, event_id: str, text: str, most_characters: int) -> DataFrame:
    """(event_id, status): 429 where the limiter refused, else 400 where the input is not valid, else 200.

    ``decisions`` is the limiter's (event_id, allowed); a request without a decision was not limited.
    """
    joined = requests.select(event_id, text).join(decisions.select(event_id, "allowed"), event_id, "left")
    status = F.when(~F.coalesce("allowed", F.lit(True)), 429).when(input_status(F.col(text), most_characters) != "ok", 400).otherwise(200)
    return joined.select(event_id, status.alias("status"))


def metric_rollup(events: DataFrame, time: str, name: str, value: str, width: str = "1 hour") -> DataFrame:
    """(window_start, name, n, total, least, greatest) of metric points."""
    return (
        events.groupBy(F.window(time, width).alias("w"), F.col(name).alias("name"))
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
        .select(F.col("w.start").alias("window_start"), "name", "n", "total", "least", "greatest")
    )


def health(checks: DataFrame, by: str, status: str) -> DataFrame:
    """(by, status, n_checks): the worst status of each component; unknown ones count as the worst."""
    severity = F.coalesce(*(F.when(F.col(status) == s, i) for i, s in enumerate(SEVERITY)), F.lit(len(SEVERITY) - 1))
    worst = F.max(severity)
    return checks.groupBy(by).agg(F.element_at(F.array(*map(F.lit, SEVERITY)), worst + 1).alias("status"), F.count("*").alias("n_checks"))


def input_status(text, most: int):
    """``ok``, ``empty``, ``too-long`` or ``invalid`` (a NUL) for a text column."""
    return (
        F.when(utrim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.length(text) > most, "too-long").when(F.contains(text, F.lit("\0")), "invalid").otherwise("ok")
    )
