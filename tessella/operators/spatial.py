"""Distance-range and nearest-neighbour joins, and the graphs made of them.

Points come as (cell_id, x, y [, z]); graphs go as edges (src, dst, weight, distance), both directions present.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import cut, require
from . import pairs

#: Points up to which all pairs are tried at once for nearest neighbours.
ALL_PAIRS = 5_000


def axes(cells: DataFrame) -> list[str]:
    """The coordinate columns: x, y and, where it is there, z."""
    require(cells, "cell_id", "x", "y")
    return ["x", "y", *(["z"] if "z" in cells.columns else [])]


def _distance(dims: list[str], a: str = "a", b: str = "b") -> Column:
    total = None
    for d in dims:
        gap = F.col(f"{a}.{d}") - F.col(f"{b}.{d}")
        total = gap * gap if total is None else total + gap * gap
    return F.sqrt(total)


def pairs_within(left: DataFrame, right: DataFrame, radius: float, dims: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of both sides at most ``radius`` apart and equal in ``by``: structs ``a`` and ``b``, and ``distance``.

    Both sides are put on a grid of that width; the right side is copied to the neighbouring squares, so the join
    is one of equal keys and no point meets another that is more than two squares away.
    """
    by = by or []
    width = radius if radius > 0 else 1.0
    square = [F.floor(F.col(d) / width).alias(f"g_{d}") for d in dims]
    same = [f"by_{c}" for c in by]
    l = left.select(F.struct(*left.columns).alias("a"), *square, *[F.col(c).alias(s) for c, s in zip(by, same)])
    r = right.select(F.struct(*right.columns).alias("b"), *square, *[F.col(c).alias(s) for c, s in zip(by, same)])
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s_{d}") for s, d in zip(step, dims)]) for step in product((-1, 0, 1), repeat=len(dims))])
    r = r.withColumn("s", F.explode(shifts)).select("b", *same, *[(F.col(f"g_{d}") + F.col(f"s.s_{d}")).alias(f"g_{d}") for d in dims])
    return l.join(r, [*same, *[f"g_{d}" for d in dims]]).select("a", "b", _distance(dims).alias("distance")).where(F.col("distance") <= radius)


def radius_graph(cells: DataFrame, radius: float, set_diag: bool = False) -> DataFrame:
    """Edges between different points at most ``radius`` apart, with weight 1.

    Coincident points are joined, at distance 0. ``set_diag`` adds a loop of weight 1 to every point.
    """
    dims = axes(cells)
    points = cells.select("cell_id", *dims)
    met = pairs_within(points, points, radius, dims).where("a.cell_id <> b.cell_id")
    edges = met.select(F.col("a.cell_id").alias("src"), F.col("b.cell_id").alias("dst"), F.lit(1.0).alias("weight"), "distance")
    return _diagonal(edges, cells) if set_diag else edges


def radius_forest(cells: DataFrame, radius: float) -> DataFrame:
    """Edges (src, dst) of ``radius_graph`` that connect all that it connects, a few for each point however dense they lie."""
    dims = axes(cells)
    return pairs.forest(cells.select("cell_id", *dims), dims, radius)


def _diagonal(edges: DataFrame, cells: DataFrame) -> DataFrame:
    return edges.unionByName(cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("distance")))


def nearest(cells: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance): the ``k`` nearest others of every point, fewer if there are not so many; ties to the lower id.

    Few points are sent to every task and compared all with all. Many are searched by a range join whose radius doubles for the points
    that have not found ``k`` others yet; what lies within the radius is then complete, so the result is exact.
    """
    dims = axes(cells)
    points = cells.select("cell_id", *dims)
    stats = points.agg(F.count("*").alias("n"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    n = stats["n"]
    k = min(k, n - 1)
    best = Window.partitionBy("src").orderBy("distance", "dst")
    shape = [F.col("a.cell_id").alias("src"), F.col("b.cell_id").alias("dst"), "distance"]

    def top(met: DataFrame) -> DataFrame:
        return met.where("src <> dst").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)

    if n <= ALL_PAIRS:
        all_ = points.toPandas().sort_values("cell_id")
        shared = cells.sparkSession.sparkContext.broadcast((all_["cell_id"].to_numpy(), all_[dims].to_numpy(float)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, at = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    own = b.column(0).to_numpy()[lo : lo + 256]
                    mine = np.column_stack([b.column(1 + i).to_numpy()[lo : lo + 256] for i in range(len(dims))])
                    d2 = np.zeros((len(own), len(ids)))
                    for i in range(len(dims)):
                        d2 += (mine[:, i][:, None] - at[:, i][None, :]) ** 2
                    far = np.sqrt(d2)
                    far[own[:, None] == ids[None, :]] = np.inf
                    best = np.argsort(far, axis=1, kind="stable")[:, :k]  # in order of ids where distances tie
                    src = np.repeat(own, best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(far, best, axis=1).ravel())], names=["src", "dst", "distance"])

        return points.select(F.col("cell_id").cast("long"), *[F.col(d).cast("double") for d in dims]).mapInArrow(compare, "src long, dst long, distance double")
    spans = [max(stats[f"hi_{d}"] - stats[f"lo_{d}"], 0.0) for d in dims]
    diagonal = math.sqrt(sum(s * s for s in spans)) or 1.0
    solid = [s for s in spans if s > 0]
    radius = 1.5 * (math.prod(solid) * (k + 1) / n) ** (1 / len(solid)) if solid else diagonal
    found, open_ = None, points
    while True:
        radius = min(radius, diagonal)
        ranked = cut(top(pairs_within(open_, points, radius, dims).select(*shape)))
        settled = ranked.where(F.col("rn") == k).select(F.col("src").alias("cell_id"))
        last = radius >= diagonal
        done = ranked if last else ranked.join(settled, F.col("src") == F.col("cell_id"), "left_semi")
        done = done.drop("rn")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        open_ = cut(open_.join(settled, "cell_id", "left_anti"))
        if open_.isEmpty():
            return found
        radius *= 2


def knn_graph(cells: DataFrame, n_neighbors: int = 6, set_diag: bool = False) -> DataFrame:
    """The graph of nearest neighbours, made symmetric: weight 1 either way, and the mean of the two directions' distances.

    An edge that only one side has counts 0 for the other, so its distance is halved, as published.
    """
    near = nearest(cells, n_neighbors)
    both = near.select("src", "dst", "distance").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    edges = both.groupBy("src", "dst").agg(F.lit(1.0).alias("weight"), (F.sum("distance") / 2).alias("distance"))
    return _diagonal(edges, cells) if set_diag else edges


def _turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Above 0 if a, b, c turn left; exact where rounding could decide."""
    l, r = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    if abs(l - r) > 1e-15 * (abs(l) + abs(r)):
        return l - r
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _in_circle(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, px: float, py: float) -> bool:
    """Whether p lies strictly inside the circle of a, b, c, which turn left; exact where rounding could decide."""

    def det(ax, ay, bx, by, cx, cy):  # noqa: ANN001, ANN202
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return a * (bx * cy - cx * by) + b * (cx * ay - ax * cy) + c * (ax * by - bx * ay), a * (abs(bx * cy) + abs(cx * by)) + b * (abs(cx * ay) + abs(ax * cy)) + c * (abs(ax * by) + abs(bx * ay))

    d, size = det(ax - px, ay - py, bx - px, by - py, cx - px, cy - py)
    if abs(d) > 4e-15 * size:
        return d > 0
    ax, ay, bx, by, cx, cy, px, py = map(Fraction, (ax, ay, bx, by, cx, cy, px, py))
    return det(ax - px, ay - py, bx - px, by - py, cx - px, cy - py)[0] > 0


def circumcircle_triangles(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points by inserting them one at a time and opening the circles that hold them.

    Points come along rows of squares, so that the next one is a few triangles away and found by walking there. Triangles
    turn left; outside of the hull each of its edges has one whose third corner, -1, lies infinitely far away.
    """
    n = len(xy)
    side = max(1, int(math.sqrt(n / 4)))
    low, span = (xy.min(axis=0), np.maximum(np.ptp(xy, axis=0), 1e-300)) if n else (0, 1)
    cell = np.minimum(((xy - low) / span * side).astype(int), side - 1)
    order = np.lexsort((np.where(cell[:, 0] % 2 == 0, cell[:, 1], -cell[:, 1]), cell[:, 0])).tolist()
    xs, ys = xy[:, 0].tolist(), xy[:, 1].tolist()
    turn = lambda a, b, c: _turn(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c])
    if n < 3:
        return np.empty((0, 3), np.int64)
    i, j = order[0], order[1]
    third = next((k for k in order[2:] if turn(i, j, k) != 0), None)
    if third is None:
        return np.empty((0, 3), np.int64)
    if turn(i, j, third) < 0:
        i, j = j, i
    # the triangle left of each directed edge, by its third corner; -1 is the far corner
    apex = {}

    def add(a: int, b: int, c: int) -> None:
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    def holds(a: int, b: int, c: int, p: int) -> bool:
        """Whether the circle of a triangle holds p; that of one outside of the hull is the half plane beyond its edge, and the edge."""
        if a < 0 or b < 0 or c < 0:
            while c >= 0:
                a, b, c = b, c, a
            t = turn(a, b, p)
            if t != 0:
                return t > 0
            return min(xs[a], xs[b]) <= xs[p] <= max(xs[a], xs[b]) and min(ys[a], ys[b]) <= ys[p] <= max(ys[a], ys[b])
        return _in_circle(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c], xs[p], ys[p])

    add(i, j, third)
    for a, b in ((i, j), (j, third), (third, i)):
        add(b, a, -1)
    at = (i, j)
    for p in order:
        if p in (i, j, third):
            continue
        # walk to a triangle whose circle holds p
        a, b = at
        c = apex[a, b]
        if c < 0:
            a, b, c = b, a, apex[b, a]
        while c >= 0:
            for u, v in ((a, b), (b, c), (c, a)):
                if turn(u, v, p) < 0:
                    a, b, c = v, u, apex[v, u]
                    break
            else:
                break
        # open all triangles beside it whose circle holds p; what is left around is the rim
        stack, rim = [(a, b), (b, c), (c, a)], []
        gone = [(a, b, c)]
        inside = {(a, b), (b, c), (c, a)}
        while stack:
            u, v = stack.pop()
            if (v, u) in inside:
                continue
            w = apex[v, u]
            if holds(v, u, w, p):
                inside |= {(v, u), (u, w), (w, v)}
                gone.append((v, u, w))
                stack += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        rim = [(u, v) for u, v in rim if (v, u) not in inside]
        for a, b, c in gone:
            del apex[a, b], apex[b, c], apex[c, a]
        for u, v in rim:
            add(u, v, p)
        at = next((u, v) for u, v in rim if u >= 0 and v >= 0) if any(u >= 0 and v >= 0 for u, v in rim) else (rim[0][1], p)
    return np.array(sorted({(a, b, c) for (a, b), c in apex.items() if 0 <= a < b and a < c}), np.int64).reshape(-1, 3)


def delaunay_graph(cells: DataFrame, set_diag: bool = False) -> DataFrame:
    """Edges of the Delaunay triangulation, both ways. Only two dimensions; of coincident points the lowest id takes part.

    A triangulation is one piece of work on one task: it holds the coordinates of all points in memory.
    """
    if len(axes(cells)) != 2:
        raise ValueError("a Delaunay graph needs two dimensions")
    points = cells.groupBy("x", "y").agg(F.min("cell_id").alias("cell_id"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        xy, ids = pdf[["x", "y"]].to_numpy(), pdf["cell_id"].to_numpy()
        t = circumcircle_triangles(xy)
        e = np.unique(np.sort(t[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1), axis=0)
        d = np.sqrt(((xy[e[:, 0]] - xy[e[:, 1]]) ** 2).sum(1))
        return pd.DataFrame({"src": np.r_[ids[e[:, 0]], ids[e[:, 1]]], "dst": np.r_[ids[e[:, 1]], ids[e[:, 0]]], "weight": 1.0, "distance": np.r_[d, d]})

    edges = points.groupBy(F.lit("all")).applyInPandas(build, "src long, dst long, weight double, distance double")
    return _diagonal(edges, cells) if set_diag else edges


def spatial_neighbors(cells: DataFrame, n_neighbors: int = 6, radius: float | None = None, percentile: float | None = None, delaunay: bool = False, set_diag: bool = False, transform: str | None = None) -> DataFrame:
    """The graph by the first choice that is given: radius, percentile of the nearest neighbours' distances, nearest neighbours."""
    from .graph import cosine_transform, spectral_transform

    if delaunay:
        edges = delaunay_graph(cells, set_diag)
    elif radius is not None:
        edges = radius_graph(cells, radius, set_diag)
    elif percentile is not None:
        near = knn_graph(cells, n_neighbors)
        edges = radius_graph(cells, float(near.agg(F.percentile("distance", percentile / 100)).first()[0]), set_diag)
    else:
        edges = knn_graph(cells, n_neighbors, set_diag)
    if transform == "spectral":
        return spectral_transform(edges)
    if transform == "cosine":
        return cosine_transform(edges, cells)
    if transform is not None:
        raise ValueError(f"no transform {transform!r}")
    return edges


def rbf_weights(cells: DataFrame, radius: float = 200.0, sigma: float = 100.0, k: int | None = None, diag_as_zero: bool = True) -> DataFrame:
    """Edges with weight exp(-d^2 / (2 sigma^2)) for 0 < d <= radius; with ``k``, the heaviest of each row; else a unit diagonal on request."""
    weight = F.exp(-(F.col("distance") * F.col("distance")) / (2 * sigma * sigma))
    if k is None:
        edges = radius_graph(cells, radius).where("distance > 0").withColumn("weight", weight)
    else:

        def slack(d2: np.ndarray) -> np.ndarray:
            """Up to where weights may be equal to that of a squared distance: some last digits, and all where they run out."""
            z = d2 / (2 * sigma * sigma)
            return np.where(z > 700, np.inf, (z + 1e-14 * (1 + z)) * (2 * sigma * sigma))

        dims = axes(cells)
        near = pairs.nearest_within(cells.select("cell_id", *dims), dims, radius, k, slack).select("src", "dst", weight.alias("weight"), "distance")
        heavy = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        edges = near.withColumn("rn", F.row_number().over(heavy)).where(F.col("rn") <= k).drop("rn")
    return edges if diag_as_zero else _diagonal(edges, cells)


def nearest_distance(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(cell_id, distance): how far the nearest target is; see ``nearest_of``."""
    return nearest_of(points, targets).select("cell_id", "distance")


def nearest_of(points: DataFrame, targets: DataFrame, target_id: str = "cell_id") -> DataFrame:
    """(cell_id, target, distance): the nearest target of every point, the lower id on a tie; without a target there are no rows.

    Few targets are broadcast and compared with every point. Many are searched by a range join whose radius doubles for
    the points that have not met one yet.
    """
    dims = axes(points)
    targets = targets.select(F.col(target_id).alias("cell_id"), *dims)
    least = F.min(F.struct("distance", F.col("b.cell_id").alias("target"))).alias("m")
    if targets.limit(ALL_PAIRS + 1).count() <= ALL_PAIRS:
        a, b = points.select(F.struct("cell_id", *dims).alias("a")), targets.select(F.struct("cell_id", *dims).alias("b"))
        return a.crossJoin(F.broadcast(b)).select("a", "b", _distance(dims).alias("distance")).groupBy("a").agg(least).select("a.cell_id", "m.target", "m.distance")
    points, targets = cut(points.select("cell_id", *dims)), cut(targets)
    both = points.select(*dims).unionAll(targets.select(*dims)).agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    spans = [both[d] for d in dims if both[d] > 0]
    diagonal = math.sqrt(sum(x * x for x in spans)) or 1.0
    radius = 1.5 * (math.prod(spans) / targets.count()) ** (1 / len(spans)) if spans else diagonal
    found, open_ = None, points
    while True:
        radius = min(radius, diagonal)
        met = cut(pairs_within(open_, targets, radius, dims).groupBy("a").agg(least).select("a.cell_id", "m.target", "m.distance"))
        found = met if found is None else found.unionByName(met)
        if radius >= diagonal:
            return found
        open_ = cut(open_.join(met, "cell_id", "left_anti"))
        if open_.isEmpty():
            return found
        radius *= 2


def hex_neighbors(cells: DataFrame) -> DataFrame:
    """(src, dst) of spots on a hexagonal grid whose names are ``{row}x{column}``."""
    part = F.split("cell_name", "x")
    at = cells.select("cell_id", F.try_element_at(part, F.lit(1)).try_cast("int").alias("r"), F.try_element_at(part, F.lit(2)).try_cast("int").alias("c")).where("r is not null and c is not null")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1))])
    probes = at.withColumn("s", F.explode(steps)).select(F.col("cell_id").alias("src"), (F.col("r") + F.col("s.r")).alias("r"), (F.col("c") + F.col("s.c")).alias("c"))
    return probes.join(at.withColumnRenamed("cell_id", "dst"), ["r", "c"]).select("src", "dst")


def micrometres(cells: DataFrame) -> DataFrame:
    """``x_um`` and ``y_um`` of spots with ``array_row`` and ``array_col`` on a grid of 100 um pitch."""
    (top,) = cells.agg(F.max("array_row")).first()
    return cells.withColumns({"x_um": F.col("array_col") * 0.5 * 100, "y_um": (F.lit(top) - F.col("array_row")) * (0.5 * math.sqrt(3) * 100)})
