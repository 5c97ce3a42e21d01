"""The steps of deconvolution against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import solvers, stats
from tessella.operators import deconvolution as d
from tessella.operators import expression
from tessella.plans import deconvolution as plans


def long(spark, m, names=("cell_id", "gene_id")):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], f"{names[0]} long, {names[1]} long, value double")


def cells_of(spark, n):
    return spark.range(n).select(F.col("id").alias("cell_id"))


def centred(m):
    x = np.log2(m / m.sum(1, keepdims=True) * 1e6 + 1)
    return x - x.mean(0)


def correlate(x, w):
    return np.array([np.corrcoef(r, w)[0, 1] if r.std() > 0 else 0.0 for r in x])


def stretched(r, k):
    s = np.sort(r)
    r = np.clip(r, s[k - 1], s[len(s) - k])
    return (r - r.min()) / (r.max() - r.min())


@pytest.fixture(scope="module")
def tumour(spark):
    rng = np.random.default_rng(11)
    m = rng.poisson(2.0, (60, 40)).astype(float)
    m[:25, :15] += rng.poisson(6.0, (25, 15))
    weights = np.r_[np.ones(15), -np.ones(15)] + rng.normal(0, 0.1, 30)
    sig = spark.createDataFrame([(g, float(w)) for g, w in enumerate(weights)], "gene_id long, weight double")
    return m, weights, long(spark, m), cells_of(spark, 60), sig


def got(df, column="fraction"):
    rows = {r.cell_id: r[column] for r in df.collect()}
    return np.array([rows[i] for i in sorted(rows)])


def test_rounds_clip_by_rank_twice(tumour):
    m, w, expr, cells, sig = tumour
    x = centred(m)
    first = stretched(np.round(correlate(x[:, :30], w), 3), 7)
    second = stretched(correlate(x, x[first >= 1].mean(0)), 7)
    fractions, chosen = plans.malignant_by_rounds(expr, cells, sig, 7)
    assert np.abs(got(fractions) - second).max() < 1e-6
    assert sorted(r.cell_id for r in chosen.collect()) == np.flatnonzero(second >= 1 - 1e-9).tolist()


def test_bulk_takes_the_significant_samples(tumour):
    m, w, expr, cells, sig = tumour
    x = centred(m)
    r = np.round(correlate(x[:, :30], w), 3)
    p = {c.cell_id: c.p_adj for c in d.signature_correlation(expr, sig, cells).collect()}
    n = max(3, sum(r[i] > 0 and p[i] < 0.25 for i in range(60)))
    assert n > 3
    fractions, chosen = plans.malignant_bulk(expr, cells, sig)
    picked = sorted(c.cell_id for c in chosen.collect())
    assert picked == sorted(sorted(range(60), key=lambda i: (-r[i], i))[:n])
    assert np.abs(got(fractions) - stretched(correlate(x, x[picked].mean(0)), 3)).max() < 1e-6


def test_clusters_give_only_spots_that_correlate(spark, tumour, monkeypatch):
    m, w, expr, cells, sig = tumour
    # a malignant cluster with spots of the other kind in it
    labels = spark.createDataFrame([(i, int(i >= 35)) for i in range(60)], "cell_id long, cluster int")
    monkeypatch.setattr(d, "cluster_cells", lambda *a, **k: labels)
    r = got(d.signature_correlation(expr, sig, cells), "r")
    _, chosen = plans.malignant_by_clusters(expr, cells, [sig])
    assert sorted(c.cell_id for c in chosen.collect()) == [i for i in range(35) if r[i] > 0]
    none = sig.withColumn("weight", -F.col("weight"))
    monkeypatch.setattr(d, "cluster_cells", lambda *a, **k: cells.withColumn("cluster", F.lit(0)))
    _, deepest = plans.malignant_by_clusters(expr, cells, [none])
    genes = (m > 0).sum(1)
    assert sorted(c.cell_id for c in deepest.collect()) == sorted(sorted(range(60), key=lambda i: (-genes[i], i))[:3])


def test_cluster_stats_take_the_share_of_all_cells(spark):
    """A cluster with a fifth of its cells significant is malignant where fewer are on the whole."""
    rows = [(i, "a" if i < 50 else "b", 0.3 if i % 5 or i >= 50 else 0.5, 0.1 if i < 50 and i % 5 == 0 else 0.9, 20 if i < 50 else 10) for i in range(100)]
    x = spark.createDataFrame(rows, "cell_id long, cluster string, r double, p_adj double, genes long")
    out = {r.cluster: r for r in d.cluster_stats(x.select("cell_id", "cluster"), x.select("cell_id", "r", "p_adj"), x.select("cell_id", "genes")).collect()}
    assert out["a"].malignant and out["a"].share_significant == pytest.approx(0.2) and out["a"].depth_gap == 5
    assert not out["b"].malignant


def marks_by_hand(x, who, tree, top, fc=0.25, fdr=0.01):
    """Markers by the definition, from the dense log matrix."""

    def test(a, b):
        p, q = x[a], x[b]
        if len(p) < 2 or len(q) < 2:
            return set()
        va, vb = p.var(0, ddof=1) / len(p), q.var(0, ddof=1) / len(q)
        t = np.where(va + vb > 1e-12, (p.mean(0) - q.mean(0)) / np.sqrt(np.where(va + vb > 1e-12, va + vb, 1)), 0)
        den = va**2 / (len(p) - 1) + vb**2 / (len(q) - 1)
        df = np.maximum((va + vb) ** 2 / np.where(den == 0, 1, den), 1)
        first = np.lexsort((np.arange(len(t)), -t))[:top]
        pv = stats.t_tail(t, df)[first]
        order = np.argsort(pv, kind="stable")
        adj = np.empty(len(pv))
        adj[order] = np.minimum(np.minimum.accumulate((pv[order] * len(pv) / np.arange(1, len(pv) + 1))[::-1])[::-1], 1)
        return {int(g) for g, v in zip(first, adj) if v < fdr and p.mean(0)[g] - q.mean(0)[g] > fc}

    out = set()
    of = {m: [i for i, s in enumerate(who) if s in subs] for m, subs in tree.items()}
    for m, subs in tree.items():
        votes = [test(of[m], of[o]) for o in tree if o != m]
        if votes:
            out |= {(m, g) for g in set.intersection(*votes)}
        if subs != [m]:
            for s in subs:
                mine = [i for i in of[m] if who[i] == s]
                out |= {(s, g) for g in test(mine, [i for i in of[m] if who[i] != s])}
    return out


def test_markers_against_every_lineage_and_all_siblings(spark):
    rng = np.random.default_rng(4)
    tree = {"T": ["T1", "T2", "T3"], "B": ["B"], "M": ["M1", "M2"]}
    subs = [s for v in tree.values() for s in v]
    who = [subs[i % 6] for i in range(90)]
    m = rng.poisson(3.0, (90, 60)).astype(float)
    for k, s in enumerate(subs):
        m[[w == s for w in who], k * 8 : k * 8 + 8] *= 6
    m[[w[0] == "T" for w in who], 50:55] += 30
    annotation = spark.createDataFrame(list(enumerate(who)), "cell_id long, sub string")
    lineage = spark.createDataFrame([(a, b) for a, v in tree.items() for b in v], "major string, sub string")
    logged = expression.log2_tpm(long(spark, m))
    x = np.log2(m / m.sum(1, keepdims=True) * 1e5 + 1)
    for top in (12, 500):
        found = {(r.cell_type, r.gene_id) for r in d.reference_markers(logged, annotation, lineage, top).collect()}
        assert found == marks_by_hand(x, who, tree, top) and found
    lonely = annotation.where("sub <> 'M2'").unionByName(annotation.where("sub = 'M2'").limit(1))
    assert {r.cell_type for r in d.reference_markers(logged, lonely, lineage).collect()} & {"M1", "M2"} == set()


def ward_by_scan(x, height_of):
    """Merges by trying every pair of clusters, from the Lance-Williams rule on squared distances."""
    d2 = {(i, j): height_of[i, j] ** 2 for i in range(len(x)) for j in range(i + 1, len(x))}
    size, out = dict.fromkeys(range(len(x)), 1), []
    while len(size) > 1:
        (i, j), h = min(d2.items(), key=lambda kv: kv[1])
        new = len(x) + len(out)
        get = lambda a, b: d2[min(a, b), max(a, b)]
        for k in size:
            if k not in (i, j):
                d2[k, new] = ((size[i] + size[k]) * get(i, k) + (size[j] + size[k]) * get(j, k) - size[k] * h) / (size[i] + size[j] + size[k])
        out.append((i, j, np.sqrt(h), size[i] + size[j]))
        size[new] = size.pop(i) + size.pop(j)
        d2 = {k: v for k, v in d2.items() if i not in k and j not in k}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ward_chains_equal_scans(seed):
    x = np.random.default_rng(seed).standard_normal((30, 4))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(solvers.ward(dist), ward_by_scan(x, dist))


def test_tails_of_f_and_chi2():
    # F(10, 10) at 2.978 and F(4, 4) at 6.388 leave 5 %; the log tail goes on where the tail has run out
    assert np.exp(stats.f_log_tail(np.array([2.9782]), 10, 10))[0] == pytest.approx(0.05, abs=1e-5)
    assert np.exp(stats.f_log_tail(np.array([6.3882]), 4, 4))[0] == pytest.approx(0.05, abs=1e-5)
    far = stats.f_log_tail(np.array([1.0, 2.0, 5.0, 50.0]), 1000, 1000)
    assert far[0] == pytest.approx(np.log(0.5)) and (np.diff(far) < 0).all() and far[3] < -1000
    assert stats.chi2_quantile(np.array([0.05, 0.5]), 100) == pytest.approx([124.342, 99.334], abs=0.01)
    assert stats.chi2_quantile(np.array([0.0, 1.0]), 9).tolist() == [np.inf, 0.0]


def test_spline_follows_a_curve_and_smooths_noise():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(-3, 3, 400))
    for truth, most in ((np.sin(x), 0.1), (0.5 * x + 1, 0.06)):
        fit = solvers.spline(x, truth + rng.normal(0, 0.2, 400))
        assert np.sqrt(((fit - truth) ** 2).mean()) < most
    line = solvers.spline(x, 2 * x - 1)
    assert np.abs(line - (2 * x - 1)).max() < 1e-6


def test_over_dispersed_genes_are_found_among_all(spark):
    rng = np.random.default_rng(5)
    means = np.exp(rng.uniform(0.5, 4, 1500))
    m = rng.poisson(means, (120, 1500)).astype(float)
    odd = rng.choice(1500, 40, replace=False)
    m[:, odd] = rng.poisson(means[odd] * rng.gamma(0.3, 1 / 0.3, (120, 40)))
    out = d.over_dispersed(long(spark, m), cells_of(spark, 120)).collect()
    over = {r.gene_id for r in out if r.over}
    assert len(over & set(odd.tolist())) >= 37 and len(over - set(odd.tolist())) <= 15
    assert all(r.scale > 0 for r in out) and len(out) == ((m.var(0) > 0).sum())


def test_clusters_of_cells(spark):
    rng = np.random.default_rng(6)
    base = rng.gamma(0.4, 12, (3, 50)) + 0.2
    m = rng.poisson(base[np.arange(60) % 3]).astype(float)
    out = {r.cell_id: r.cluster for r in d.cluster_cells(long(spark, m), cells_of(spark, 60), choose="best").collect()}
    assert all(len({out[i] for i in range(k, 60, 3)}) == 1 for k in range(3)) and len(set(out.values())) in (2, 3)


@pytest.mark.parametrize("n_cells", [60, 2400])
def test_patterns_choose_the_same_k_at_any_size(spark, n_cells):
    rng = np.random.default_rng(2)
    use = np.eye(4)[np.arange(n_cells) % 4] * rng.uniform(3, 5, (n_cells, 4))
    load = np.eye(4)[np.arange(20) % 4] * rng.uniform(3, 5, (20, 4))
    v = use @ load.T + rng.uniform(0, 0.2, (n_cells, 20))
    rows = [(i, f"p{j:02}", float(v[i, j])) for i in range(n_cells) for j in range(20)]
    act = spark.createDataFrame(rows, "cell_id long, protein string, zscore double")
    cells, proteins = d.signaling_patterns(act, [2, 4, 3], 60)
    assert proteins.select("pattern").distinct().count() == 4 and cells.count() == 4 * n_cells
    top = {}
    for r in proteins.collect():
        if r.weight > top.get(r.gene, (-1, 0))[0]:
            top[r.gene] = (r.weight, r.pattern)
    assert all(len({top[f"p{j:02}"][1] for j in range(k, 20, 4)}) == 1 for k in range(4))


@pytest.mark.parametrize("histogram", [10, 10**6])
def test_order_statistics(spark, monkeypatch, histogram):
    monkeypatch.setattr(stats, "HISTOGRAM", histogram)
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal(5000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    ranks = [1, 2, 250, 2500, 4751, 5000]
    assert stats.order_statistics(df, "v", ranks, 5000) == np.sort(x)[[r - 1 for r in ranks]].tolist()
    got = sorted(r.v for r in expression.clip_min_max(df, "v").collect())
    assert np.allclose(got, np.sort(stretched(x, 250)))


def test_correlation_makes_no_zeros(spark):
    """20,000 cells with a gene of their own each: 400 million dense values, of which 20,000 are stored."""
    n = 20_000
    expr = spark.range(n).select(F.col("id").alias("cell_id"), F.col("id").alias("gene_id"), F.lit(3.0).alias("value"))
    sig = spark.range(n).select(F.col("id").alias("gene_id"), F.col("id").cast("double").alias("weight"))
    r = got(d.centred_correlation(expr, cells_of(spark, n), lambda logged, means: sig), "r0")
    # a cell's values are constant but for one, so that r follows from the place of its weight
    w = np.arange(n) - (n - 1) / 2
    assert np.abs(r - w / np.sqrt((w * w).sum() * (1 - 1 / n))).max() < 1e-9


def test_correlation_of_empty_and_constant_cells(spark):
    m = np.array([[4.0, 0, 3, 1], [0, 0, 0, 0], [1, 5, 0, 2], [2, 2, 0, 7]])
    w = np.array([1.0, -2, 0.5, 3])
    x = np.log2(m / np.maximum(m.sum(1, keepdims=True), 1) * 1e6 + 1)
    sig = spark.createDataFrame([(g, float(v)) for g, v in enumerate(w)], "gene_id long, weight double")
    r = got(d.centred_correlation(long(spark, m), cells_of(spark, 4), lambda *_: sig), "r0")
    assert np.allclose(r, correlate(x - x.mean(0), w))
    one = d.centred_correlation(long(spark, m[:1]), cells_of(spark, 1), lambda *_: sig).collect()
    assert [(c.r0, c.n) for c in one] == [(None, 3)]
