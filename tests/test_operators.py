import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import solvers, stats
from tessella.model import require
from tessella.operators import deconvolution, expression, graph, interaction, moran, permutation, raster, signaling, spatial, survival
from tessella.plans import plotdata


def points(spark, n=200, seed=1, size=100.0):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * size
    labels = rng.choice(list("ABC"), n)
    return xy, spark.createDataFrame([(i, float(x), float(y), str(l)) for i, ((x, y), l) in enumerate(zip(xy, labels))], "cell_id long, x double, y double, cluster string")


def distances(xy):
    return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))


def mask(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(r, c)], "row int, col int, label int")


# graphs


def test_radius_join_equals_brute_force(spark):
    xy, cells = points(spark)
    d = distances(xy)
    got = {(r.src, r.dst) for r in spatial.radius_graph(cells, 9.0).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero((d <= 9) & (d > 0)))}


def test_radius_join_in_three_dimensions(spark):
    rng = np.random.default_rng(3)
    xyz = rng.random((100, 3))
    cells = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "cell_id long, x double, y double, z double")
    d = distances(xyz)
    assert spatial.radius_graph(cells, 0.3).count() == int(((d <= 0.3) & (d > 0)).sum())


def test_coincident_points_and_diagonal(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 9.0, 9.0)], "cell_id long, x double, y double")
    assert {(r.src, r.dst, r.distance) for r in spatial.radius_graph(cells, 1.0).collect()} == {(1, 2, 0.0), (2, 1, 0.0)}
    assert spatial.radius_graph(cells, 1.0, set_diag=True).where("src = dst").count() == 3


@pytest.mark.parametrize("all_pairs", [10, 10_000])
def test_nearest_equals_brute_force(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(spatial, "ALL_PAIRS", all_pairs)
    xy, cells = points(spark, 150)
    xy2 = np.vstack([xy, [[1000.0, 1000.0]]])
    cells = cells.select("cell_id", "x", "y").union(spark.createDataFrame([(150, 1000.0, 1000.0)], "cell_id long, x double, y double"))
    d = distances(xy2)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in spatial.nearest(cells, 5).collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert got == {i: set(np.argsort(row, kind="stable")[:5].tolist()) for i, row in enumerate(d)}


def test_knn_is_symmetric_and_k_is_capped(spark):
    _, cells = points(spark, 40)
    e = {(r.src, r.dst): r.distance for r in spatial.knn_graph(cells, 4).collect()}
    assert all(e[(b, a)] == pytest.approx(v) for (a, b), v in e.items())
    few = spatial.knn_graph(cells.where("cell_id < 3"), 6)
    assert few.count() == 6


def test_delaunay_circles_are_empty(spark):
    xy, cells = points(spark, 60, 5)
    t = spatial.circumcircle_triangles(xy)
    for a, b, c in t:
        m = np.array([xy[b] - xy[a], xy[c] - xy[a]])
        centre = xy[a] + np.linalg.solve(m, (m**2).sum(1) / 2)
        r = np.linalg.norm(xy[a] - centre)
        assert (np.linalg.norm(xy - centre, axis=1) > r - 1e-6).all()
    edges = spatial.delaunay_graph(cells)
    assert edges.count() == 2 * len(np.unique(np.sort(t[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1), axis=0))
    assert edges.groupBy("src").count().agg(F.min("count")).first()[0] >= 2
    with pytest.raises(ValueError):
        spatial.delaunay_graph(cells.withColumn("z", F.lit(0.0)))


def test_rbf_weights_fall_with_distance(spark):
    _, cells = points(spark)
    w = spatial.rbf_weights(cells, 20, 10)
    assert w.where("weight > 1 or weight <= 0").isEmpty()
    r = w.first()
    assert r.weight == pytest.approx(math.exp(-r.distance**2 / 200))


def test_spatial_neighbors_precedence(spark):
    _, cells = points(spark, 50)
    assert spatial.spatial_neighbors(cells, radius=5.0, percentile=50).count() == spatial.radius_graph(cells, 5.0).count()
    with pytest.raises(ValueError):
        spatial.spatial_neighbors(cells, transform="none")
    with pytest.raises(KeyError):
        require(cells, "nothing")


def test_components_and_laplacian(spark):
    cells = spark.range(6).select(F.col("id").alias("cell_id"))
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (4, 5), (5, 4)], "src long, dst long").withColumns({"weight": F.lit(1.0), "distance": F.lit(1.0)})
    assert {r.cell_id: r.component for r in graph.connected_components(cells, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    rows = graph.laplacian(edges, cells, normalized=False).groupBy("src").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in rows) and len(rows) == 6
    c = {r.cell_id: r.closeness for r in graph.closeness(cells, edges).collect()}
    assert c[1] == pytest.approx(2 / 2 * 2 / 5) and c[3] == 0
    b = {r.cell_id: r.betweenness for r in graph.betweenness(cells, edges).collect()}
    assert b[1] == pytest.approx(2 / 20) and b[0] == 0
    assert graph.lonely(cells, edges).count() == 1
    assert graph.spectral_transform(edges).where("src = 0").first().weight == pytest.approx(1 / math.sqrt(2))


# labels


def test_enrichment_invariants(spark):
    _, cells = points(spark, 60)
    edges = spatial.knn_graph(cells, 4)
    out = permutation.nhood_enrichment(cells, edges, "cluster", 20).collect()
    assert len(out) == 9 and sum(r.n for r in out) == edges.count()
    assert sum(r.mean for r in out) == pytest.approx(edges.count())
    again = permutation.nhood_enrichment(cells.repartition(7), edges, "cluster", 20).collect()
    assert {(r.label_src, r.label_dst): r.z for r in out} == {(r.label_src, r.label_dst): r.z for r in again}
    labels = permutation.permuted_labels(cells, "cluster", 3)
    for r in labels.groupBy("perm", "label").count().collect():
        assert r["count"] == cells.where(F.col("cluster") == r.label).count()


def test_co_occurrence_shares_sum_to_one(spark):
    _, cells = points(spark, 60)
    out = permutation.co_occurrence(cells, "cluster", 0, 60, 6)
    for r in out.groupBy("bin").agg(F.sum("value").alias("v")).collect():
        assert r.v == pytest.approx(1.0)
    assert out.where("bin = 0 and label_src = 'A' and label_dst = 'A'").first().n >= cells.where("cluster = 'A'").count()


def test_ripley_rises(spark):
    xy, cells = points(spark, 120)
    radii = [5.0, 10.0, 20.0]
    rows = sorted(permutation.ripley(cells, "cluster", radii, "K").collect(), key=lambda r: (r.label, r.radius))
    assert all(a.value <= b.value for a, b in zip(rows, rows[1:]) if a.label == b.label)
    labels = {r.cell_id: r.cluster for r in cells.collect()}
    at = [i for i in range(120) if labels[i] == "A"]
    d = distances(xy[at])
    assert [r.pairs for r in rows if r.label == "A"] == [int(((d > 0) & (d <= r)).sum()) for r in radii]
    env = permutation.ripley_envelope(cells, "cluster", radii, 5).collect()
    assert all(r.low <= r.mean <= r.high for r in env)
    assert len(permutation.default_radii(cells, 10)) == 10 and permutation.default_interval(cells)[1] > 0


# expression and Moran


def counts(spark, m):
    r, c = np.nonzero(m)
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(r, c)], "cell_id long, gene_id long, value double"), spark.range(len(m)).select(F.col("id").alias("cell_id"))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.cell_id, r.gene_id] = r.value
    return out


def test_normalisation_counts_zeros(spark):
    m = np.random.default_rng(2).poisson(0.7, (20, 12))
    m[3] = 0
    expr, cells = counts(spark, m)
    total = np.where(m.sum(1) == 0, 1, m.sum(1))[:, None]
    logged = np.log2(m / total * 1e6 + 1)
    assert np.allclose(dense(expression.cpm_log2_center(expr, cells, dense=True), m.shape), logged - logged.mean(0))
    assert np.allclose(dense(expression.log2_tpm(expr), m.shape), np.log2(m / total * 1e5 + 1))
    qc = {r.cell_id: (r.umi, r.genes) for r in expression.quality_control(cells, expr, 0).collect()}
    assert qc[3] == (0.0, 0) and len(qc) == 20
    assert expression.quality_control(cells, expr, 1).count() == int((m.sum(1) > 0).sum())
    v = {r.gene_id: r.var_samp for r in expression.gene_means(expr, cells).collect()}
    assert all(v[g] == pytest.approx(m[:, g].var(ddof=1)) for g in v)


def test_ucell_equals_dense_ranks(spark):
    m = np.random.default_rng(4).poisson(1.0, (10, 30))
    expr, cells = counts(spark, m)
    genes = spark.range(30).select(F.col("id").alias("gene_id"))
    sets = spark.createDataFrame([("a", g) for g in range(5)] + [("b", 29), ("none", 99)], "set_name string, gene_id long")
    got = {(r.cell_id, r.set_name): r.score for r in expression.ucell(expr, cells, genes, sets).collect()}
    for i, row in enumerate(m):
        rank = np.array([(row > v).sum() + ((row == v).sum() + 1) / 2 for v in row])
        assert got[(i, "a")] == pytest.approx(1 - rank[:5].mean() / 30)
        assert got[(i, "b")] == pytest.approx(1 - rank[29] / 30) and got[(i, "none")] == 0
    assert expression.gene_set_score(expr, cells, genes, sets, expression.ucell(expr, cells, genes, sets)).count() == 60


def test_dedup_genes_keeps_the_larger(spark):
    expr = spark.createDataFrame([(0, 0, 8.0), (0, 1, 3.0), (0, 2, 11.0)], "cell_id long, gene_id long, value double")
    genes = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "gene_id long, gene_name string")
    assert {(r.gene_name, r.total) for r in expression.dedup_genes(expr, genes).collect()} == {("A", 11.0), ("B", 3.0)}


def test_moran_equals_dense(spark):
    xy, cells = points(spark, 50)
    m = np.random.default_rng(5).poisson(1.0, (50, 4)).astype(float)
    m[:, 3] = 2
    expr, _ = counts(spark, m)
    edges = spatial.rbf_weights(cells, 30, 15)
    w = np.zeros((50, 50))
    for r in edges.collect():
        w[r.src, r.dst] = r.weight
    z = (m - m.mean(0)) / np.where(m.std(0) == 0, 1, m.std(0))
    want = z.T @ w @ z / w.sum()
    got = {r.gene_id: r.i for r in moran.univariate(expr, cells, edges).collect()}
    assert all(got[g] == pytest.approx(want[g, g], abs=1e-9) for g in range(4)) and got[3] == 0
    pair = {(r.gene_a, r.gene_b): r.i for r in moran.pairwise(expr, cells, edges).collect()}
    assert all(pair[(a, b)] == pytest.approx(want[a, b], abs=1e-9) for a in range(4) for b in range(4))


def test_moran_finds_a_gradient(spark):
    xy, cells = points(spark, 60)
    m = np.random.default_rng(6).poisson(3.0, (60, 3))
    m[:, 0] = (xy[:, 0] / 5).astype(int)
    expr, _ = counts(spark, m)
    out = {r.gene_id: r for r in moran.univariate_test(expr, cells, spatial.rbf_weights(cells, 40, 20), 20).collect()}
    assert out[0].i > 0.2 and out[0].p == pytest.approx(1 / 21) and out[0].p_adj >= out[0].p


# statistics


def test_tails():
    assert stats.t_tail(np.array([2.0, 0.0, -12.706]), np.array([10.0, 5.0, 1.0])) == pytest.approx([0.073388, 1.0, 0.05], abs=1e-5)
    assert stats.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)
    assert stats.chi2_tail_1(np.array([3.841459])) == pytest.approx([0.05], abs=1e-6)
    assert stats.normal_tail(np.array([1.959964])) == pytest.approx([0.05], abs=1e-6)


@pytest.mark.parametrize("a,b,sign", [([5, 6, 7, 8, 9], [1, 2, 3, 4, 5], 1), ([1, 2, 3], [10, 11, 12], -1), ([4, 4], [4, 4], 0)])
def test_cohens_d(spark, a, b, sign):
    df = spark.createDataFrame([(True, float(v)) for v in a] + [(False, float(v)) for v in b], "g boolean, v double")
    d = df.agg(stats.cohens_d(F.col("g"), F.col("v")).alias("d")).first().d
    assert (d > 1) if sign > 0 else (d < 0) if sign < 0 else d == 0


def test_bh_and_rank(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r.i: r.p_adj for r in stats.bh_adjust(df, "p").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got[4] is None
    r = spark.createDataFrame([("a", v) for v in (3, 1, 3, 2)], "k string, v int").withColumn("r", stats.average_rank(["k"], "v"))
    assert sorted(x.r for x in r.collect()) == [1.0, 2.0, 3.5, 3.5]
    s = spark.createDataFrame([(123456.0,), (0.0012345,), (0.0,), (-2.5,)], "v double").select(stats.significant(F.col("v"), 3).alias("s"))
    assert [x.s for x in s.collect()] == pytest.approx([123000.0, 0.00123, 0.0, -2.5])


# interaction


def test_interface_fixture(spark):
    names = ["10x10", "10x12", "10x14", "11x11", "11x13", "12x10", "12x12", "12x14"]
    share = [0.8, 0.1, 0.7, 0.9, 0.05, 0.6, 0.02, 0.85]
    cells = spark.createDataFrame([(i, n, 0.0, 0.0) for i, n in enumerate(names)], "cell_id long, cell_name string, x double, y double")
    f = spark.createDataFrame([(i, "Malignant", v) for i, v in enumerate(share)], "cell_id long, cell_type string, fraction double")
    got = {r.cell_id: r.label for r in interaction.interface(cells, f).collect()}
    assert {i for i, l in got.items() if l == "Tumor"} == {i for i, v in enumerate(share) if v >= 0.5}
    assert got[1] == got[4] == got[6] == "Interface"


def test_edge_swap_keeps_degrees():
    rng = np.random.default_rng(1)
    m = np.argwhere(rng.random((10, 15)) < 0.3)
    right = interaction.edge_swap(m[:, 0], m[:, 1], rng)
    assert (np.sort(right) == np.sort(m[:, 1])).all() and len({*zip(m[:, 0].tolist(), right.tolist())}) == len(m)
    assert (right != m[:, 1]).any()
    assert interaction.edge_swap(np.array([1]), np.array([2]), rng).tolist() == [2]


def test_lr_scores(spark):
    m = np.array([[5, 3, 0], [0, 2, 1], [0, 0, 0]])
    expr, cells = counts(spark, m)
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "ligand long, receptor long")
    l = np.log2(m / np.maximum(m.sum(1, keepdims=True), 1) * 1e6 + 1)
    got = {r.cell_id: r.score for r in interaction.lr_raw_score(expr, cells, pairs).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(((l[:, 0] * l[:, 1] + l[:, 1] * l[:, 2]) / 2).tolist())
    net = {r.cell_id: r for r in interaction.lr_network_score(expr, cells, pairs, 10).collect()}
    assert net[2].score == 0 and net[2].p == 1.0 and all(0 < r.p <= 1 for r in net.values())


def test_distance_to_interface(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0) for i in range(12)], "cell_id long, x double, y double")
    labels = spark.createDataFrame([(0, "Interface")] + [(i, "Stroma") for i in range(1, 12)], "cell_id long, label string")
    groups = spark.createDataFrame([(i, "Both" if i < 3 else "A") for i in range(1, 12)], "cell_id long, `group` string")
    r = interaction.distance_to_interface(cells, labels, groups, 50).first()
    assert r.observed == pytest.approx(1.5) and r.null_mean > 3 and r.p == pytest.approx(1 / 51)


# solvers and deconvolution


@pytest.mark.parametrize("seed", range(8))
def test_nnls_equals_best_subset(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 5)) - 0.2, rng.random(12) - 0.3
    assert np.linalg.norm(a @ solvers.nnls(a, b) - b) == pytest.approx(np.linalg.norm(a @ solvers.best_subset(a, b) - b), abs=1e-8)


def test_constrained_fits():
    rng = np.random.default_rng(0)
    a = rng.random((30, 4))
    for total in (0.2, 0.9, 3.0):
        x = solvers.bounded_sum(a, a @ np.array([0.5, 0.1, 0.0, 0.3]), total, total)
        assert x.sum() == pytest.approx(total) and (x >= 0).all()
    assert solvers.solve_fractions(np.eye(2), np.array([0.5, 0.5]), 1.0) == pytest.approx([0.5, 0.5], abs=0.1)
    for theta in (0.005, 0.001):
        assert solvers.solve_fractions(rng.random((6, 3)), rng.random(6), theta) == pytest.approx([theta / 3] * 3)
    x = solvers.solve_fractions(a, a @ np.array([2.0, 1, 0, 0]), 0.7)
    assert (x >= 0).all() and x.sum() <= 0.7 + 1e-9


def test_clusters_and_factors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((3, 20)) * 5
    x = np.vstack([base[i] + rng.standard_normal((10, 20)) for i in range(3)])
    labels = solvers.cluster_correlation(x, "best")
    assert len(set(labels)) == 3 and all(len(set(labels[i * 10 : i * 10 + 10])) == 1 for i in range(3))
    v = rng.random((8, 3)) @ rng.random((3, 10))
    w, h = solvers.nmf(v, 3, 2000)
    assert np.abs(w @ h - v).max() < 0.05 and (w >= 0).all()
    assert solvers.principal_components(x, 5).shape == (30, 5)


def test_deconvolution_recovers_mixtures(spark):
    rng = np.random.default_rng(1)
    types = {"T": ["T1", "T2"], "B": ["B"]}
    profile = {t: rng.gamma(0.5, 50, 40) for t in ("T1", "T2", "B")}
    profile["T"] = (profile["T1"] + profile["T2"]) / 2
    truth = [(0.5, 0.0, 0.5), (0.0, 0.0, 1.0), (0.45, 0.45, 0.1)]
    unit = {t: p / p.sum() * 1e6 for t, p in profile.items()}
    m = np.array([sum(f * unit[t] for f, t in zip(x, ("T1", "T2", "B"))) for x in truth])
    expr, cells = counts(spark, m)
    ref = spark.createDataFrame([(g, t, float(p[g])) for t, p in profile.items() for g in range(40)], "gene_id long, cell_type string, value double")
    lineage = spark.createDataFrame([(k, s) for k, v in types.items() for s in v], "major string, sub string")
    sig = spark.createDataFrame([("none", 0)], "cell_type string, gene_id long")
    got = {(r.cell_id, r.cell_type): r.fraction for r in deconvolution.deconvolve(expr, cells, ref, lineage, sig).collect()}
    assert got[(1, "B")] == pytest.approx(1.0, abs=0.05) and got[(0, "B")] == pytest.approx(0.5, abs=0.15)
    for i in range(3):
        assert got[(i, "T1")] + got[(i, "T2")] == pytest.approx(got[(i, "T")], abs=1e-6)
        assert got[(i, "T")] + got[(i, "B")] + got[(i, "Unidentifiable")] == pytest.approx(1.0, abs=1e-6)


def test_references(spark):
    expr, cells = counts(spark, np.random.default_rng(7).poisson(2.0, (12, 15)))
    note = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)], "cell_id long, sub string")
    tree = spark.createDataFrame([("A", "a"), ("B", "b")], "major string, sub string")
    deconvolution.validate_reference(expr, note, tree)
    with pytest.raises(ValueError):
        deconvolution.validate_reference(expr, note.where("cell_id > 0"), tree)
    with pytest.raises(ValueError):
        deconvolution.validate_reference(expr, note, tree.where("sub = 'a'"))
    ref = deconvolution.generate_reference(expr, note, tree)
    assert all(abs(r.s - 1e5) < 1e-6 for r in ref.groupBy("cell_type").agg(F.sum("value").alias("s")).collect())
    assert deconvolution.downsample(note, 4).groupBy("sub").count().agg(F.max("count")).first()[0] == 4
    marks = deconvolution.welch_markers(expr, note.withColumnRenamed("sub", "group"), "a", least_fc=-9.0, fdr=1.1)
    assert marks.count() == 15 and marks.where("p_adj < p").isEmpty()
    r = deconvolution.signature_correlation(expr, spark.createDataFrame([(g, float(g)) for g in range(15)], "gene_id long, weight double"), cells)
    assert r.where("abs(r) > 1 or p_adj < p - 1e-12").isEmpty() and r.count() == 12
    f = deconvolution.malignant_fraction(r).agg(F.min("fraction"), F.max("fraction")).first()
    assert tuple(f) == (0.0, 1.0)


# signalling and survival


def test_ridge_activity_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    m, s = rng.poisson(3.0, (5, 20)), rng.standard_normal((20, 3))
    expr, _ = counts(spark, m)
    sig = spark.createDataFrame([(g, f"p{j}", float(s[g, j])) for g in range(20) for j in range(3)], "gene_id long, protein string, weight double")
    want = np.linalg.solve(s.T @ s + 10 * np.eye(3), s.T @ m.T)
    for r in signaling.ridge_activity(expr, sig, 10.0, 5).collect():
        assert r.beta == pytest.approx(want[int(r.protein[1]), r.cell_id])


def test_velocity_points_from_sender(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "cell_id long, x double, y double")
    edges = spatial.radius_graph(cells, 6.0)
    expr = spark.createDataFrame([(1, 2.0)], "cell_id long, value double")
    act = spark.createDataFrame([(2, 5.0), (1, -1.0)], "cell_id long, value double")
    r = signaling.velocity(edges, cells, expr, act).first()
    assert (r.cell_id, r.total, r.dx, r.dy) == (2, 10.0, pytest.approx(6.0), pytest.approx(8.0))
    a = signaling.velocity_arrows(signaling.velocity(edges, cells, expr, act)).first()
    assert a.vec_len in (0.01, 0.08) and plotdata.viewport(signaling.velocity_arrows(signaling.velocity(edges, cells, expr, act)), 0, 100, 0, 100).count() == 1


def test_kaplan_meier_and_logrank(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1), ("b", 4.0, 1), ("b", 4.0, 1)]
    df = spark.createDataFrame(rows, "g string, time double, event int")
    km = {(r.g, r.time): r.survival for r in survival.kaplan_meier(df, ["g"]).collect()}
    assert km == {("a", 1.0): pytest.approx(2 / 3), ("a", 2.0): pytest.approx(2 / 3), ("a", 3.0): 0.0, ("b", 4.0): 0.0}
    r = survival.logrank(df, "g").first()
    assert r.observed == 2 and r.expected == pytest.approx(2 / 5 + 2 / 3 + 2) and 0 < r.p < 1


def test_cox_finds_the_effect(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    t = rng.exponential(1 / np.exp(0.8 * x))
    beta, se = survival.cox_fit(t, np.ones(400), x)
    assert beta == pytest.approx(0.8, abs=0.2) and 0 < se < 0.1
    assert math.isnan(survival.cox_fit(t[:5], np.zeros(5), x[:5])[0])
    df = spark.createDataFrame([("p", float(a), 1, float(b)) for a, b in zip(t, x)] + [("q", 1.0, 0, 1.0)], "protein string, time double, event int, value double")
    got = {r.protein: r.beta for r in survival.cox(df).collect()}
    assert got["p"] == pytest.approx(beta) and got["q"] is None
    with pytest.raises(ValueError):
        survival.join_survival(spark.createDataFrame([("x",)], "sample string"), spark.createDataFrame([("y", 1.0, 1)], "sample string, time double, event int"))


def test_splits(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert survival.split(df, "v").where("`group` = 'High'").count() == 5
    assert survival.split(df, "v", how="tertile").count() == 6


# rasters

FOUR = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 2, 2], [0, 0, 0, 0]])


def test_areas_and_boundaries(spark):
    got = {r.label: (r.area, r.centroid_row, r.centroid_col) for r in raster.segments(mask(spark, FOUR)).collect()}
    assert got == {1: (4, 0.5, 0.5), 2: (2, 2.0, 2.5)}
    a = np.zeros((5, 5), int)
    a[1:4, 1:4] = 1
    edge = {(r.row, r.col) for r in raster.boundaries(mask(spark, a)).collect()}
    assert len(edge) == 8 and (2, 2) not in edge
    assert raster.boundaries(mask(spark, a), 2).count() == 8


def test_size_and_edge_filters(spark):
    a = np.array([[1, 1, 1, 2], [1, 1, 1, 0], [1, 1, 0, 0], [0, 3, 3, 0], [0, 3, 3, 0]])
    out = raster.filter_by_size(mask(spark, a), 2)
    assert out.count() == 12 and {r.label for r in out.collect()} == {1, 2} and out.where("row = 0 and col = 3").isEmpty()
    b = np.array([[1, 1, 0, 2, 2], [1, 0, 0, 0, 2], [0, 0, 3, 0, 0], [4, 0, 0, 0, 5], [4, 4, 0, 5, 5]])
    assert {r.label for r in raster.remove_edge_cells(mask(spark, b), 5, 5).collect()} == {3}


def test_segmentation_metrics(spark):
    a, b = np.zeros((6, 6), int), np.zeros((6, 6), int)
    a[:2, :2], b[3:5, 3:5] = 1, 1
    r = raster.segmentation_metrics(mask(spark, a), mask(spark, b)).first()
    assert (r.tp, r.fp, r.fn) == (0, 1, 1)
    b = np.zeros((6, 6), int)
    b[:2, :3] = 1
    r = raster.segmentation_metrics(mask(spark, a), mask(spark, b)).first()
    assert r.tp == 1 and r.mean_iou == pytest.approx(4 / 6) and r.f1 == 1.0
    assert raster.segmentation_metrics(mask(spark, a), mask(spark, a)).first().foreground_iou == 1.0
    empty = mask(spark, a).where("false")
    assert raster.segmentation_metrics(empty, empty).first().f1 == 1.0
    with pytest.raises(ValueError):
        raster.matches(mask(spark, a), mask(spark, a), 0)


def test_tiles_components_and_expansion(spark):
    one = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 0]])
    two = np.array([[0, 0, 0], [0, 0, 0], [0, 0, 1]])
    merged = raster.merge_tiles([(0, 0, one), (1, 1, two)], (4, 4))
    assert len(np.unique(merged)) == 3
    assert raster.tile_grid(10, 10, 6, 1) == [(0, 0), (0, 5), (5, 0), (5, 5)]
    assert {r.label for r in raster.components(mask(spark, FOUR).select("row", "col")).collect()} == {1, 2}
    wide = {(r.row, r.col): r.label for r in raster.expand(mask(spark, FOUR), 4, 4, 1).collect()}
    assert wide[(0, 2)] == 1 and wide[(2, 0)] == 1 and wide[(3, 3)] == 2 and (3, 0) not in wide
    both = raster.combine([mask(spark, FOUR), mask(spark, one)], "intersection")
    assert both.count() == 4
    image = np.where(FOUR > 0, 1.0, 0.0)
    tiles = spark.createDataFrame([(0, 0, 0, 4, 4, bytearray(image.tobytes()))], "image_id long, top int, left int, h int, w int, data binary")
    assert raster.segment_tiles(tiles, raster.threshold_model(0.5)).select("label").distinct().count() == 2


def test_transcripts(spark):
    t = spark.createDataFrame([(0.5, 0.5, "g"), (-3.0, 0.2, "g"), (9.0, 9.0, "h"), (2.2, 2.9, "h")], "x double, y double, gene string")
    got = raster.assign(t, mask(spark, FOUR), 4, 4)
    assert sorted(r.label for r in got.collect()) == [0, 1, 1, 2]
    assert raster.transcript_counts(got, mask(spark, FOUR), 2).select("label", "gene", "n").collect() == [(1, "g", 2)]
    d = {r.label: r.density for r in raster.transcript_density(got, mask(spark, FOUR)).collect()}
    assert d == {1: 0.5, 2: 0.5}
    q = raster.quality_metrics(mask(spark, FOUR), 4, 4).first()
    assert q.n == 2 and q.coverage == pytest.approx(6 / 16)
