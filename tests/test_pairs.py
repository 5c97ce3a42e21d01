"""Sums over pairs in blocks against brute force, and that no row is made for a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, pairs, permutation, signaling, spatial


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "SQUARE", 8)
    monkeypatch.setattr(pairs, "BLOCK", 16)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.normal(0, 0.1, (150, 2)), rng.random((50, 2)), [[0.5, 0.5], [0.5, 0.5]]])
    labels = rng.choice(list("ABC"), len(xy))
    cells = spark.createDataFrame([(i, float(x), float(y), str(l)) for i, ((x, y), l) in enumerate(zip(xy, labels))], "cell_id long, x double, y double, cluster string")
    return xy, labels, cells, np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)


def test_bounds_are_exact():
    for r in (0.03, 0.1, 1 / 3):
        s = pairs.within(r)
        assert np.sqrt(s) <= r < np.sqrt(np.nextafter(s, 1))
    assert pairs.bound(lambda s: bool(s < 0)) == -1.0


def test_bins_of_all_pairs(cloud):
    xy, labels, cells, d = cloud
    got = {(r.bin, r.label_src, r.label_dst): r.n for r in permutation.co_occurrence(cells, "cluster", 0.05, 0.35, 3).collect()}
    assert got == {(k, a, b): int(((d >= 0.05) & (d < 0.35) & (np.minimum(np.floor((d - 0.05) / ((0.35 - 0.05) / 3)), 2) == k) & (labels[:, None] == a) & (labels[None] == b)).sum()) for k in range(3) for a in "ABC" for b in "ABC"}
    near = {(r.label, r.radius): r.pairs for r in permutation.ripley(cells, "cluster", [0.05, 0.2]).collect()}
    assert near == {(a, r): int(((d > 0) & (d <= r) & (labels[:, None] == a) & (labels[None] == a)).sum()) for a in "ABC" for r in (0.05, 0.2)}


def test_simulated_points_follow_the_hash(spark):
    box = {"label": "A", "sim": 3, "n": 5, "x0": 1.0, "x1": 4.0, "y0": -1.0, "y1": 0.5}
    x, y = permutation._uniform_points(box, 7)
    from tessella.model import uniform

    want = spark.range(1, 6).select(*[uniform(F.lit(f"7{a}"), F.lit("A"), F.lit(3), "id").alias(a) for a in "xy"]).toPandas()
    assert np.allclose(x, 1 + 3 * want["x"]) and np.allclose(y, -1 + 1.5 * want["y"])
    rng = np.random.default_rng(0)
    x, y = rng.random(400), rng.random(400)
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    assert permutation._close_pairs(x, y, np.array([0.0, pairs.within(0.1), pairs.within(0.3)]), 0.3).tolist() == [int(((d > 0) & (d <= 0.1)).sum()), int(((d > 0.1) & (d <= 0.3)).sum())]


def test_graphs_without_their_edges(spark, cloud):
    xy, _, cells, d = cloud
    edges = spatial.radius_graph(cells, 0.06)
    forest = spatial.radius_forest(cells, 0.06)
    assert forest.count() < edges.count() / 2
    parts = lambda e: {r.cell_id: r.component for r in graph.connected_components(cells, e).collect()}
    assert parts(forest) == parts(edges)
    got = {(r.src, r.dst) for r in spatial.rbf_weights(cells, 0.2, 0.1, 3).collect()}
    w = np.where((d > 0) & (d <= 0.2), np.exp(-(d * d) / (2 * 0.1 * 0.1)), -1)
    assert got == {(i, int(j)) for i in range(len(xy)) for j in np.lexsort((np.arange(len(xy)), -w[i]))[:3] if w[i, j] >= 0}


@pytest.mark.parametrize("mode", ["receiving", "sending"])
def test_flow_without_edges(cloud, mode):
    cells = cloud[2]
    e, a = (cells.select("cell_id", ((F.col("cell_id") * m) % 5 - 1).cast("double").alias("value")) for m in (2, 3))
    rows = lambda v: {r.cell_id: (r.dx, r.dy, r.total) for r in v.collect()}
    got, want = rows(signaling.velocity_within(cells, e, a, 0.1, mode)), rows(signaling.velocity(spatial.radius_graph(cells, 0.1), cells, e, a, mode))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("passes", [1, 16])
def test_talking_cells(cloud, monkeypatch, passes):
    monkeypatch.setattr(signaling, "PROTEINS", passes)
    xy, labels, cells, d = cloud
    p = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    e, v = (p.select("cell_id", F.concat(F.lit("p"), "k").alias("protein"), ((F.col("cell_id") * (F.col("k") + m)) % 5 - 2).cast("double").alias("value")) for m in (2, 3))
    near = (d <= 0.1) & (labels[:, None] != labels[None])
    i = np.arange(len(xy))
    want = {}
    for a in "ABC":
        for b in "ABC":
            m = near & (labels[:, None] == a) & (labels[None] == b)
            for k in range(3):
                s, t = (i * (k + 2)) % 5 - 2, (i * (k + 3)) % 5 - 2
                n = int((m & (s[:, None] > 0) & (t[None] > 0)).sum())
                if n and (m.any(1).sum() >= 0.05 * (labels == a).sum() or m.any(0).sum() >= 0.05 * (labels == b).sum()):
                    want[a, f"p{k}", b] = (int(m.sum()), n, float((m * s[:, None] * t[None]).sum()))
    got = {(r.sender, r.protein, r.receiver): (r.neighboring_pairs, r.communicating_pairs, r.total) for r in signaling._neighbour_counts(cells, "cluster", e, v, 0.1, totals=True).collect()}
    assert got == want and want


def test_draws_repeat_after_the_prime(monkeypatch):
    at = np.r_[np.arange(500), np.arange(2**32 - 300, 2**32 + 300)]
    for n in (1, 7, 10_007):
        assert (signaling._places(2**28 - 1, at.copy(), n) == signaling.drawn(2**28 - 1, at, n)).all()
    monkeypatch.setattr(signaling, "_PRIME", 101)
    f = np.random.default_rng(1).integers(0, 5, (101, 2)).astype(float)
    for n in (1, 2, 7, 250):
        parts = signaling._segments(n, 50)
        assert sum(hi - lo for lo, hi in parts) <= 101
        got = signaling._background(np.array([f[lo:hi].sum(0) for lo, hi in parts]), n, 50)
        assert np.allclose(got, [f[np.arange(k * n, k * n + n) % 101].mean(0) for k in range(50)])
