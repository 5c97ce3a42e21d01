"""What plots show, as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import require
from ..operators.expression import quality_control, scaled_feature
from ..operators.interaction import most_abundant
from ..operators.spatial import nearest_of


def quality(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """(cell_id, x, y, umi, genes)"""
    return cells.select("cell_id", "x", "y").join(quality_control(cells, expr, 0), "cell_id")


def gene_expression(cells: DataFrame, expr: DataFrame, gene_id: int, scale: str = "LogTPM") -> DataFrame:
    """(cell_id, x, y, value): a gene at every cell, 0 where it is not stored."""
    scaled = scaled_feature(expr, scale).where(F.col("gene_id") == gene_id).select("cell_id", "value")
    return cells.select("cell_id", "x", "y").join(scaled, "cell_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def fractions(cells: DataFrame, fraction: DataFrame, types: list[str] | None = None) -> DataFrame:
    f = fraction if types is None else fraction.where(F.col("cell_type").isin(types))
    return cells.select("cell_id", "x", "y").join(f, "cell_id")


def abundant_type(cells: DataFrame, fraction: DataFrame) -> DataFrame:
    return cells.select("cell_id", "x", "y").join(most_abundant(fraction), "cell_id")


def _at_cells(cells: DataFrame, values: DataFrame, name: str, wanted: list | None) -> DataFrame:
    """Values (cell_id, name, ...) with the place of their cell, of all features or the wanted ones that there are."""
    some = values if wanted is None else values.where(F.col(name).isin(wanted))
    return cells.select("cell_id", "x", "y").join(some, "cell_id")


def interface(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, x, y, label): the kind of every spot beside the tumour's edge."""
    return cells.select("cell_id", "x", "y").join(labels.select("cell_id", "label"), "cell_id")


def gene_set_scores(cells: DataFrame, scores: DataFrame, sets: list[str] | None = None) -> DataFrame:
    """(cell_id, x, y, set_name, score)"""
    return _at_cells(cells, scores.select("cell_id", "set_name", "score"), "set_name", sets)


def activity(cells: DataFrame, activities: DataFrame, proteins: list[str] | None = None) -> DataFrame:
    """(cell_id, x, y, protein, zscore)"""
    return _at_cells(cells, activities.select("cell_id", "protein", "zscore"), "protein", proteins)


def patterns(cells: DataFrame, weights: DataFrame, wanted: list[int | str] | None = None) -> DataFrame:
    """(cell_id, x, y, pattern, weight); ``All`` among the wanted patterns means all."""
    return _at_cells(cells, weights.select("cell_id", "pattern", "weight"), "pattern", None if wanted is not None and "All" in wanted else wanted)


def metadata(cells: DataFrame, features: list[str]) -> DataFrame:
    """(cell_id, x, y, feature, value): columns of the cells as rows, values as text; an unknown one is an error."""
    require(cells, "cell_id", "x", "y", *features)
    return cells.select("cell_id", "x", "y", *[F.col(f).cast("string").alias(f) for f in features]).unpivot(["cell_id", "x", "y"], features, "feature", "value")


def sankey_nodes(ccc: DataFrame, gap: float = 0.02) -> DataFrame:
    """(side, name, n, height, y_center) of senders, proteins and receivers: stacked from 0 by their number, the largest first, a gap between them."""
    sides = None
    for side, c in (("sender", "sender"), ("protein", "protein"), ("receiver", "receiver")):
        one = ccc.groupBy(F.lit(side).alias("side"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
        sides = one if sides is None else sides.unionByName(one)
    order = Window.partitionBy("side").orderBy(F.desc("n"), "name")  # a row for each node of the drawing
    height = F.col("n") / F.sum("n").over(Window.partitionBy("side"))
    nodes = sides.withColumns({"height": height, "k": F.row_number().over(order) - 1})
    below = F.sum("height").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("height") + F.col("k") * gap
    return nodes.select("side", "name", "n", "height", (below + F.col("height") / 2).alias("y_center"))


def arrow_intensity(arrows: DataFrame, points: DataFrame) -> DataFrame:
    """Arrows with ``intensity``: the value of the point (cell_id, x, y, value) nearest to where they start."""
    starts = arrows.select("cell_id", F.col("x_start").alias("x"), F.col("y_start").alias("y"))
    near = nearest_of(starts.distinct(), points).select("cell_id", F.col("target").alias("__t"))
    return arrows.join(near, "cell_id").join(points.select(F.col("cell_id").alias("__t"), F.col("value").alias("intensity")), "__t").drop("__t")


def contour(points: DataFrame, n_grid: int = 80, smoothing: float = 0.05) -> DataFrame:
    """(row, col, x, y, value): points (x, y, value) smoothed by a thin plate onto a square grid over their box, values below 0 cut off.

    ``smoothing`` is a share of the longer side of the box. One task solves a system of as many equations as there are points.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "value"])
        at, v = pdf[["x", "y"]].to_numpy(float), pdf["value"].to_numpy(float)
        low, high = at.min(axis=0), at.max(axis=0)
        mid, half = (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0)

        def plate(a: np.ndarray) -> np.ndarray:
            r2 = ((a[:, None] - at[None]) ** 2).sum(-1)
            return 0.5 * r2 * np.log(np.maximum(r2, 1e-300))

        def plane(a: np.ndarray) -> np.ndarray:
            return np.column_stack([np.ones(len(a)), (a - mid) / half])

        p, n = plane(at), len(at)
        system = np.block([[plate(at) + smoothing * float((high - low).max()) * np.eye(n), p], [p.T, np.zeros((3, 3))]])
        c = np.linalg.lstsq(system, np.r_[v, np.zeros(3)], rcond=None)[0]
        xs, ys = (np.linspace(low[i], high[i], n_grid) for i in (0, 1))
        grid = np.array([(x, y) for y in ys for x in xs])
        z = np.maximum(plate(grid) @ c[:n] + plane(grid) @ c[n:], 0)
        place = np.arange(n_grid * n_grid)
        return pd.DataFrame({"row": place // n_grid, "col": place % n_grid, "x": grid[:, 0], "y": grid[:, 1], "value": z})

    return points.select("x", "y", "value").groupBy(F.lit("all")).applyInPandas(solve, "row int, col int, x double, y double, value double")


def lr_score(scores: DataFrame) -> DataFrame:
    """(cell_id, score, log_p): the network score clipped to [0.5, 1.5] and -log10 p."""
    return scores.select("cell_id", F.least(F.greatest("score", F.lit(0.5)), F.lit(1.5)).alias("score"), (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("log_p"))


def spot_places(cells: DataFrame, flip_x: bool = False) -> DataFrame:
    """(cell_id, x, y) of names ``{row}x{column}``; other names are at (0, 0)."""
    part = F.split("cell_name", "x")
    at = cells.select("cell_id", F.try_element_at(part, F.lit(2)).try_cast("double").alias("c"), F.try_element_at(part, F.lit(1)).try_cast("double").alias("r"))
    ok = F.col("c").isNotNull() & F.col("r").isNotNull()
    at = at.select("cell_id", F.when(ok, F.col("c")).otherwise(0.0).alias("x"), F.when(ok, F.col("r")).otherwise(0.0).alias("y"))
    if not flip_x:
        return at
    return at.crossJoin(F.broadcast(at.agg(F.max("x").alias("top")))).select("cell_id", (F.col("top") - F.col("x")).alias("x"), "y")


def viewport(arrows: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Arrows both of whose ends lie strictly inside."""
    inside = None
    for a in ("x_start", "x_end"):
        c = (F.col(a) > x0) & (F.col(a) < x1)
        inside = c if inside is None else inside & c
    for a in ("y_start", "y_end"):
        inside = inside & (F.col(a) > y0) & (F.col(a) < y1)
    return arrows.where(inside)


def colocalization_caps(pairs: DataFrame, rho_cap: float = 0.3, p_cap: float = 10.0) -> DataFrame:
    """rho and -log10 p cut off for the colours and sizes of a dot plot."""
    return pairs.select("type_a", "type_b", F.least(F.greatest("rho", F.lit(-rho_cap)), F.lit(rho_cap)).alias("rho"), F.least(-F.log10(F.greatest("p", F.lit(1e-300))), F.lit(p_cap)).alias("log_p"))


def dot_labels(ccc: DataFrame) -> DataFrame:
    """(pair, protein, ratio, log_p): rows of a communication dot plot."""
    return ccc.select(F.concat_ws(" -> ", "sender", "receiver").alias("pair"), "protein", "ratio", (-F.log10(F.greatest("pv_adj", F.lit(1e-300)))).alias("log_p"))


def linear_fit(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """(slope, intercept); weights multiply residuals, so their squares weigh."""
    w = F.col(weight) * F.col(weight) if weight else F.lit(1.0)
    s = df.agg(F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("x"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(x) * F.col(x)).alias("xx"), F.sum(w * F.col(x) * F.col(y)).alias("xy"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(slope.alias("slope"), F.try_divide(F.col("y") - slope * F.col("x"), F.col("w")).alias("intercept"))
