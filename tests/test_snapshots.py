import random

from statloom.operators.snapshots import snapshot_changes, validity_intervals

SCHEMA = "source string, snapshot_no int, key string, at int, title string, content string, hash string, delivery int"
ARGS = ("source", "snapshot_no", "key", "at", ["title", "content"])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 7) for r in rows], SCHEMA)


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(frame(spark, rows), *ARGS).select("source", "snapshot_no", "key", "change_kind").collect()), key=str)


def brute(rows):
    current = {}
    for s, n, k, at, t, c in rows:
        now = (at is not None, at or 0, t, c)
        if (s, n, k) not in current or now[:2] > current[s, n, k][:2]:
            current[s, n, k] = now
    out = []
    for s in {r[0] for r in rows}:
        numbers = sorted({r[1] for r in rows if r[0] == s})
        for a, b in zip(numbers, numbers[1:], strict=False):
            for k in {r[2] for r in rows}:
                old, new = current.get((s, a, k)), current.get((s, b, k))
                if old and not new:
                    out.append((s, b, k, "removed"))
                elif new and not old:
                    out.append((s, b, k, "added"))
                elif new and old and new[2:] != old[2:]:
                    out.append((s, b, k, "changed"))
    return sorted(out, key=str)


def test_empty_and_single_deliveries(spark):
    assert changes(spark, []) == []
    assert changes(spark, [("s", 3, "a", 1, "t", "c"), ("s", 3, "a", 1, "t", "c")]) == []


def test_latest_row_counts_and_gaps_come_back_as_added(spark):
    rows = [
        ("s", 1, "a", 1, "t", "old"), ("s", 1, "a", 2, "t", "new"), ("s", 1, "a", None, "t", "none"),
        ("s", 2, "b", 1, "t", "c"),
        ("s", 5, "a", 1, "t", "new"), ("s", 5, "b", 9, "t", "c"),
        ("s", 6, "a", 1, "t", "new "), ("s", 6, "b", 9, None, "c"),
        (None, 1, "a", 1, "t", ""), (None, 2, "a", 1, "t", None),
    ]
    assert changes(spark, rows) == sorted(
        [("s", 2, "a", "removed"), ("s", 2, "b", "added"), ("s", 5, "a", "added"), ("s", 6, "a", "changed"), ("s", 6, "b", "changed"), (None, 2, "a", "changed")], key=str
    )
    intervals = {tuple(r) for r in validity_intervals(frame(spark, rows), *ARGS).filter("source = 's'").select("key", "valid_from", "valid_to").collect()}
    assert intervals == {("a", 1, 1), ("a", 5, 5), ("a", 6, 6), ("b", 2, 5), ("b", 6, 6)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in ("x", "y", None):
        for n in range(1, 9):
            if rng.random() < 0.8:
                # a third of all rows has one key
                rows += [(s, n, k, i, rng.choice("tu"), rng.choice(["c", "d", None])) for i, k in enumerate(rng.choices("aaabcdef", k=rng.randint(1, 12)))]
    rng.shuffle(rows)
    assert changes(spark, rows) == brute(rows)
