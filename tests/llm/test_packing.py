import itertools
import random

import numpy as np

from statloom.llm.packing import fill, fullest, pack


def test_fullest_finds_the_best_sum():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        room = rng.randint(0, 40)
        sums = {sum(n * x for n, x in zip(take, counts, strict=True)) for take in itertools.product(*(range(c + 1) for c in counts.values()))}
        chosen = fullest(room, sorted(counts), counts)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[x] for x, n in chosen.items())


def test_fill_keeps_the_capacity_and_wastes_little():
    sizes = np.array(random.Random(4).choices(range(1, 3000), k=4000) + [0, 0, 4096])
    container = fill(sizes, 4096)
    loads = np.bincount(container, sizes)
    assert loads.max() <= 4096 and sizes.sum() / (len(loads) * 4096) > 0.99
    assert len(fill(np.array([], np.int64), 10)) == 0
    assert fill(np.array([0, 0]), 10).tolist() == [0, 0]


def test_every_item_comes_out_once(spark):
    rows = [(i, s) for i, s in enumerate([5, 3, 0, None, 10, 11, 25, 30, 7, 7, 7, 3])] + [(0, 5), (0, 5), (None, 4)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "id long, size int, window int, container_id string")
    for window_rows in (4, 1_000):
        got = pack(df, "id", "size", 10, window_rows).collect()
        load, pieces = {}, {}
        for r in got:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.id, []).append((r.piece_no, r.n_tokens))
        assert max(load.values()) <= 10
        assert sorted(pieces[6]) == [(0, 10), (1, 10), (2, 5)] and sorted(pieces[7]) == [(0, 10), (1, 10), (2, 10)] and sorted(pieces[5]) == [(0, 10), (1, 1)]
        assert sorted(pieces[0]) == [(0, 5)] * 3 and pieces[3] == [(0, 0)] and pieces[None] == [(0, 4)]
        assert sum(map(len, pieces.values())) == 15 + 2 + 2 + 1
    assert pack(df.limit(0), "id", "size", 10).count() == 0


def test_one_length_may_hold_a_third_of_all_items(spark):
    df = spark.range(9_000).selectExpr("id", "cast(if(id % 3 = 0, 1366, 1 + id % 900) as int) as size")
    got = pack(df, "id", "size", 4_096, 3_000).groupBy("container_id").sum("n_tokens").collect()
    # three items of 1,366 just do not fit together
    assert max(r[1] for r in got) <= 4_096 and sum(r[1] for r in got) / (4_096 * len(got)) > 0.95
