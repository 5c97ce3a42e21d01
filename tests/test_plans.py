import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import chunked, coordinates, null_nan
from tessella.plans import deconvolution, plotdata, timing


@pytest.fixture(scope="module")
def mixture(spark):
    """Forty spots of two cell types and a malignant one, with single cells of each."""
    rng = np.random.default_rng(8)
    profile = {t: rng.gamma(0.3, 60, 60) + 0.5 for t in ("Malignant", "T", "B")}
    names = list(profile)
    p = np.array([profile[n] / profile[n].sum() for n in names])
    truth = np.vstack([rng.dirichlet([8, 1, 1], 20), rng.dirichlet([0.3, 4, 4], 20)])
    m = rng.poisson(truth @ p * 20_000)
    sc = np.vstack([rng.poisson(np.outer(np.full(12, 4000), p[k])) for k in range(3)])

    def long(x):
        r, c = np.nonzero(x)
        return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(r, c)], "cell_id long, gene_id long, value double")

    note = spark.createDataFrame([(i, names[i // 12]) for i in range(36)], "cell_id long, sub string")
    tree = spark.createDataFrame([(n, n) for n in names], "major string, sub string")
    ref = spark.createDataFrame([(g, n, float(profile[n][g])) for n in names for g in range(60)], "gene_id long, cell_type string, value double")
    sig = spark.createDataFrame([(g, float(np.log2(p[0, g] / p[1:, g].mean()))) for g in range(60)], "gene_id long, weight double")
    return {"expr": long(m), "cells": spark.range(40).select(F.col("id").alias("cell_id")), "truth": truth, "sc": long(sc), "note": note, "tree": tree, "ref": ref, "sig": sig}


def wide(df, kind):
    got = {r.cell_id: r.fraction for r in df.where(F.col("cell_type") == kind).collect()}
    return np.array([got[i] for i in range(40)])


def test_deconvolution_finds_the_malignant_part(spark, mixture):
    x = mixture
    normal = x["ref"].where("cell_type <> 'Malignant'")
    tree = x["tree"].where("major <> 'Malignant'")
    marks = spark.createDataFrame([("none", 0)], "cell_type string, gene_id long")
    out = deconvolution.deconvolution(x["expr"], x["cells"], normal, tree, marks, [x["sig"]])
    assert np.corrcoef(wide(out, "Malignant"), x["truth"][:, 0])[0, 1] > 0.8
    bulk = deconvolution.deconvolution_bulk(x["expr"], x["cells"], normal, tree, marks, x["sig"])
    assert np.corrcoef(wide(bulk, "Malignant"), x["truth"][:, 0])[0, 1] > 0.8
    parts = deconvolution.deconvolution_malignant(x["expr"], x["cells"], out)
    s = parts.where("cell_type like 'Malignant state%'").groupBy("cell_id").agg(F.sum("fraction").alias("s")).collect()
    m = dict(enumerate(wide(out, "Malignant")))
    assert s and all(r.s == pytest.approx(m[r.cell_id], abs=1e-6) for r in s)
    healthy = deconvolution.deconvolution(x["expr"], x["cells"], normal, tree, marks, [], adjacent_normal=True)
    assert healthy.where("cell_type = 'Malignant'").isEmpty()


def test_matched_reference(spark, mixture):
    x = mixture
    out = deconvolution.deconvolution_matched(x["expr"], x["cells"], x["sc"], x["note"], x["tree"])
    for k, name in enumerate(("Malignant", "T", "B")):
        assert np.corrcoef(wide(out, name), x["truth"][:, k])[0, 1] > 0.8


def test_plot_data(spark):
    cells = spark.createDataFrame([(1, "3x4", 0.0, 0.0), (2, "bad", 1.0, 1.0)], "cell_id long, cell_name string, x double, y double")
    assert {r.cell_id: (r.x, r.y) for r in plotdata.spot_places(cells).collect()} == {1: (4.0, 3.0), 2: (0.0, 0.0)}
    assert {r.cell_id: r.x for r in plotdata.spot_places(cells, True).collect()} == {1: 0.0, 2: 4.0}
    expr = spark.createDataFrame([(1, 7, 3.0), (1, 8, 1.0)], "cell_id long, gene_id long, value double")
    got = {r.cell_id: r.value for r in plotdata.gene_expression(cells, expr, 7, "LogTPM").collect()}
    assert got[1] == pytest.approx(np.log2(750_001)) and got[2] == 0
    with pytest.raises(ValueError):
        plotdata.gene_expression(cells, expr, 7, "none")
    s = plotdata.lr_score(spark.createDataFrame([(1, 9.0, 0.01)], "cell_id long, score double, p double")).first()
    assert (s.score, s.log_p) == (1.5, 2.0)
    f = plotdata.linear_fit(spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 5.0, 2.0), (3.0, 7.0, 1.0)], "a double, b double, w double"), "a", "b", "w").first()
    assert (f.slope, f.intercept) == (pytest.approx(2.0), pytest.approx(1.0))


def test_helpers(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("array_col"), F.lit(float("nan")).alias("array_row"))
    assert coordinates(df).columns[-2:] == ["x", "y"]
    with pytest.raises(KeyError):
        coordinates(spark.range(1))
    assert null_nan(df).where("array_row is not null").isEmpty()
    assert chunked(spark.range(10), lambda b: b * 2, "id long", 3).agg(F.sum("id")).first()[0] == 90
    t = timing.benchmark(lambda: spark.range(5), n_runs=2, name="x")
    assert len(t.times) == 2 and "| x |" in timing.table({"x": t}) and t.speedup_over(t) == 1.0


def test_projections_of_features(spark):
    cells = spark.createDataFrame([(1, 0.0, 1.0, "a"), (2, 2.0, 3.0, "b")], "cell_id long, x double, y double, kind string")
    scores = spark.createDataFrame([(1, "s", 0.5), (1, "t", 0.1), (2, "s", 0.2)], "cell_id long, set_name string, score double")
    assert sorted((r.cell_id, r.x, r.score) for r in plotdata.gene_set_scores(cells, scores, ["s", "none"]).collect()) == [(1, 0.0, 0.5), (2, 2.0, 0.2)]
    act = scores.withColumnsRenamed({"set_name": "protein", "score": "zscore"})
    assert plotdata.activity(cells, act).count() == 3 and plotdata.activity(cells, act, ["t"]).count() == 1
    w = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.1)], "cell_id long, pattern int, weight double")
    assert plotdata.patterns(cells, w, [1]).first().weight == 0.1 and plotdata.patterns(cells, w, ["All"]).count() == 2
    assert sorted((r.cell_id, r.feature, r.value) for r in plotdata.metadata(cells, ["kind"]).collect()) == [(1, "kind", "a"), (2, "kind", "b")]
    with pytest.raises(KeyError):
        plotdata.metadata(cells, ["none"])


def test_contour_is_a_smoothed_surface(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 10, (150, 2))
    plane = 3 + 0.5 * at[:, 0] + 0.2 * at[:, 1]
    rows = lambda v: spark.createDataFrame([(float(x), float(y), float(z)) for (x, y), z in zip(at, v)], "x double, y double, value double")
    got = plotdata.contour(rows(plane), 12).toPandas()
    assert len(got) == 144 and np.abs(got["value"] - (3 + 0.5 * got["x"] + 0.2 * got["y"])).max() < 1e-6
    hill = plotdata.contour(rows(np.exp(-((at - 5) ** 2).sum(1) / 4) - 0.1), 21, 0.001).toPandas()
    top = hill.loc[hill["value"].idxmax()]
    assert abs(top["x"] - 5) < 1 and abs(top["y"] - 5) < 1 and (hill["value"] >= 0).all()


def test_images_are_segmented_from_grid_to_mask(spark):
    from tessella.operators import raster

    image = np.zeros((90, 70))
    for k, (r, c) in enumerate([(3, 4), (28, 30), (60, 33), (75, 58), (31, 8)]):
        image[r : r + 6, c : c + 6] = k + 1.0
    frames = spark.createDataFrame([(i, 90, 70, bytearray((image * (i + 1)).tobytes())) for i in range(2)], "image_id long, h int, w int, data binary")
    out = raster.segment_images(frames, raster.threshold_model(0.5), 32, 12).toPandas()
    whole = raster.threshold_model(0.5)(image)
    for _, part in out.groupby("image_id"):
        pairs = {(int(a), int(b)) for a, b in zip(part["label"], whole[part["row"], part["col"]])}
        assert len(part) == (whole > 0).sum() and len(pairs) == 5 and len({a for a, _ in pairs}) == 5
