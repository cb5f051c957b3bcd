"""Filling containers of fixed capacity by minimum bin slack.

Items are spread over windows of about ``window_rows`` rows; each window is filled by itself in one task. In a window
only the multiset of remaining lengths matters: the largest remaining item opens a container, a bitset holds which sums
the other lengths can reach in the room left, the highest reachable sum is traced back to counts of each length, and the
pattern is repeated as long as the counts allow.

Defined cases
- An item that exceeds the capacity is cut into pieces of the capacity and a rest; all others stay whole.
- Items of size 0 or null take no room and go into the first container of their window.
- Repeated rows are items of their own. Extra columns are ignored. An empty table gives no rows.
- Windows and containers follow from the rows alone, not from how files are split: equal items are counted, and their
  numbers within that count spread them over the windows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a window: large enough that its last, poorly filled containers do not count, small enough for one task.
WINDOW_ROWS = 20_000


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length (ascending) fill ``room`` best; stops at the first exact fit."""
    mask, target, reach = (1 << (room + 1)) - 1, 1 << room, 1
    steps: list[tuple[int, int, int]] = []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        take = 1
        while most:
            take = min(take, most)
            reach |= (reach << (take * length)) & mask
            most -= take
            take *= 2
        if reach & target:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        for n in range(most + 1):
            if left >= n * length and before >> (left - n * length) & 1:
                break
        if n:
            chosen[length] = n
            left -= n * length
    return chosen


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; 0 <= size <= capacity. Containers count from 0."""
    container = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    values, starts, numbers = np.unique(sizes[order], return_index=True, return_counts=True)
    # rows of each length, handed out from the front
    rows = {int(v): iter(order[s : s + n].tolist()) for v, s, n in zip(values, starts, numbers, strict=True)}
    counts = {int(v): int(n) for v, n in zip(values, numbers, strict=True)}
    counts.pop(0, None)
    lengths, used = sorted(counts), 0
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        pattern = fullest(capacity - largest, lengths, counts)
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        for _ in range(min(counts[x] // n for x, n in pattern.items())):
            for x, n in pattern.items():
                counts[x] -= n
                for _ in range(n):
                    container[next(rows[x])] = used
            used += 1
        for x in pattern:
            if not counts[x]:
                del counts[x], lengths[bisect_right(lengths, x) - 1]
    return container


def pack(items: DataFrame, key: str, size: str, capacity: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(key, piece_no, n_tokens, container_id): every item in one container, or its pieces in several."""
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    windows = max(1, -(-items.count() // window_rows))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))),
        lambda i: F.struct(i.cast("int").alias("piece_no"), F.least(F.col("size") - i * capacity, F.lit(capacity)).cast("int").alias("n_tokens")),
    )

    def in_window(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "key", "piece_no"], ignore_index=True)
        container = fill(rows["n_tokens"].to_numpy(), capacity)
        return rows.assign(container_id=rows["window"].astype("int64") * 2**32 + container)[["key", "piece_no", "n_tokens", "container_id"]]

    counted = sized.groupBy("key", "size").agg(F.count("*").alias("n")).select("key", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return (
        counted.select("key", "copy", F.inline(pieces))
        .withColumn("window", F.pmod(F.xxhash64("key", "piece_no", "n_tokens", "copy"), F.lit(windows)).cast("int"))
        # windows are small but take their time: as many tasks as windows, which adaptive execution leaves alone
        .repartition(windows, "window")
        .groupBy("window")
        .applyInPandas(in_window, f"key {items.schema[key].dataType.simpleString()}, piece_no int, n_tokens int, container_id long")
        .withColumnRenamed("key", key)
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: (n_containers, n_over, n_tokens, share_filled) of what :func:`pack` gave."""
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    total = F.coalesce(F.sum("load"), F.lit(0))
    return loads.agg(
        F.count("*").alias("n_containers"), F.count_if(F.col("load") > capacity).alias("n_over"), total.alias("n_tokens"), F.try_divide(total, F.count("*") * capacity).alias("share_filled")
    )
