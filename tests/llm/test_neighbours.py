import numpy as np
import pytest

from statloom.llm import neighbours
from statloom.llm.neighbours import nearest, neighbour_pairs

SCHEMA = "ord long, embedding array<float>, vector string"


def truth(ids, x, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 12)
    out = {}
    for i, own in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cosine[i, j], ids[j]))[:k]
        out[own] = [ids[j] for j in order]
    return out


def run(spark, ids, x, k=5, unit_rows=64):
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "clash") for i, r in zip(ids, x, strict=True)], SCHEMA)
    found = {}
    for r in nearest(df, "ord", "embedding", k, x.shape[1], unit_rows).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.neighbour)
    return found


def recall(got, want):
    return np.mean([len({*got.get(i, [])} & {*n}) / len(n) for i, n in want.items()])


def clustered(n, size, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, size)) * 0.5).astype(np.float32)


def test_clustered_vectors_are_exact(spark):
    x = clustered(600, 32, 12, 1)
    ids = np.random.default_rng(2).permutation(600) * 3
    assert run(spark, ids, x) == truth(ids.tolist(), x, 5)


def test_vectors_without_clusters_are_joined_in_full(spark):
    x = np.random.default_rng(3).normal(size=(500, 64)).astype(np.float32)
    assert recall(run(spark, range(500), x), truth([*range(500)], x, 5)) >= 0.9
    near = x * 0.2 + 1  # one cell that has to be split
    assert run(spark, range(500), near) == truth([*range(500)], near, 5)


def test_more_loose_rows_than_a_sample_takes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEARN_ROWS", 40)
    x = clustered(800, 32, 30, 4)
    assert recall(run(spark, range(800), x), truth([*range(800)], x, 5)) >= 0.9


def test_copies_ties_and_scaled_rows(spark):
    x = clustered(200, 16, 4, 5)
    x[:70] = x[0]  # a third of all rows is one vector
    x[70:80] = x[80:90]
    ids = np.random.default_rng(6).permutation(200)
    assert run(spark, ids, x) == truth(ids.tolist(), x, 5)


def test_who_is_a_member(spark):
    good = clustered(30, 8, 2, 7)
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(good)]
    rows += [(100, None, "x"), (101, [], "x"), (102, [0.0] * 8, "x"), (103, [1.0] * 7, "x"), (104, [1.0] * 9, "x"), (105, [float("nan")] * 8, "x"), (106, [None, *[1.0] * 7], "x"), (None, [1.0] * 8, "x")]
    rows += rows[:10]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in neighbour_pairs(df, "ord", "embedding", 3, 8).collect()}
    want = truth([*range(30)], good, 3)
    assert got == {(min(a, b), max(a, b)) for a, n in want.items() for b in n}
    assert neighbour_pairs(df.limit(0), "ord", "embedding", 3, 8).count() == 0
    assert neighbour_pairs(df.filter("ord = 1"), "ord", "embedding", 3, 8).count() == 0
    assert {tuple(r) for r in neighbour_pairs(df.filter("ord < 3"), "ord", "embedding", 3, 8).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_quantisation_bound_holds():
    unit = neighbours._unit(clustered(300, 48, 5, 8))
    codes, scale, error = neighbours._quantised(unit)
    near = (codes.astype(np.float64) @ codes.T.astype(np.float64)) * scale[:, None] * scale[None, :]
    slack = error[:, None] + error[None, :] + error[:, None] * error[None, :]
    assert (np.abs(near - unit @ unit.T) <= slack + 1e-12).all()


def test_every_pair_of_units_that_must_meet_has_a_tile():
    plan = neighbours.Layout({1: 300, 2: 20, 3: 20, 4: 900}, 256)
    met = {frozenset(t) for t in plan.tiles}
    split = [plan.first_unit[4] + i for i in range(plan.parts[4])]
    assert plan.parts == {1: 2, 2: 1, 3: 1, 4: 4} and plan.first_unit[2] == plan.first_unit[3]
    assert all(frozenset((a, b)) in met for a in split for b in split)
    assert all(frozenset((u,)) in met for c in plan.first_unit for u in plan.units(c))


def test_cells_grow_with_the_rows(spark, monkeypatch):
    """Every cluster gets a centre, however few rows a group learns from, and no row is without a cell."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)
    monkeypatch.setattr(neighbours, "LEARN_ROWS", 100)
    for clusters in (40, 160):
        x = clustered(clusters * 30, 48, clusters, 9)
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
        centres = neighbours.fit_cells(df, 48)[0].value.centres
        assert clusters <= len(centres) <= 2 * clusters
    near = neighbours.Cells(centres)
    want = near.nearest(neighbours._unit(x))[0]
    monkeypatch.setattr(neighbours, "DIRECT", 16)
    got = neighbours.Cells(centres).nearest(neighbours._unit(x))[0]
    assert (got == want).mean() > 0.97
    assert recall(run(spark, range(len(x)), x), truth([*range(len(x))], x, 5)) == 1


def test_bounded_probes_keep_recall(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(2_000, 8)) @ np.linalg.qr(rng.normal(size=(48, 8)))[0].T).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, embedding array<float>")
    found = {}
    for r in nearest(df, "ord", "embedding", 10, 48, 256, probes=16).collect():
        found.setdefault(r.id, []).append(r.neighbour)
    assert recall(found, truth([*range(2_000)], x, 10)) >= 0.9


@pytest.mark.parametrize("intrinsic", [6, 8, 12])
def test_neighbours_across_cells_of_a_continuous_cloud(spark, intrinsic):
    rng = np.random.default_rng(intrinsic)
    x = (rng.normal(size=(2_000, intrinsic)) @ np.linalg.qr(rng.normal(size=(48, intrinsic)))[0].T).astype(np.float32)
    assert run(spark, range(2_000), x, k=10, unit_rows=256) == truth([*range(2_000)], x, 10)
