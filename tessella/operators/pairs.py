"""Pairs of points within a radius, worked on in blocks: what is asked of pairs is summed up where they are found, and no row is made for a pair."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import cut, spread

#: Points of a block, points that a square should have on the average, and pairs that are looked at at once.
BLOCK = 4_096
SQUARE = 512
AT_ONCE = 65_536

#: Columns of a block: names to arrays of equal length.
Block = dict[str, np.ndarray]
Pairs = Callable[[Block, Block, bool], pa.RecordBatch | None]


def block_pairs(left: DataFrame, right: DataFrame | None, radius: float, dims: list[str], found: Pairs, schema: str, by: list[str] | None = None) -> DataFrame:
    """Rows that ``found`` makes of pairs of blocks of both sides, which together hold all pairs of points within the radius and equal in ``by``.

    Points lie on a grid of squares at least as wide as the radius and wide enough to hold some hundred; a block has points of
    one square, ``BLOCK`` at most, and meets those of the same and the neighbouring squares. Without a right side the left one
    meets itself: then of two blocks one meets the other, and ``found`` is told whether they are the same. Columns are numbers
    without nulls.
    """
    by, key = by or [], [f"g_{d}" for d in dims]
    both = left.select(*by, *dims) if right is None else left.select(*by, *dims).unionAll(right.select(*by, *dims))
    stats = both.agg(F.count("*").alias("n"), F.count_distinct(*by).alias("k") if by else F.lit(1).alias("k"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    spans = [stats[d] for d in dims if (stats[d] or 0) > 0]
    width = max(radius, (math.prod(spans) * SQUARE * stats["k"] / stats["n"]) ** (1 / len(spans)) if spans else 0.0) or 1.0

    def blocks(df: DataFrame) -> DataFrame:
        placed = df.select(*df.columns, *[F.floor(F.col(d) / width).alias(g) for d, g in zip(dims, key)])
        numbered = placed.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*by, *key).orderBy(dims[0])) - 1) / BLOCK))
        packed = numbered.groupBy(*by, *key, "part").agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
        return cut(packed.select(F.struct(*by, *key, "part").alias("at"), *[F.col("rows")[c].alias(f"c_{c}") for c in df.columns]))

    a = blocks(left)
    b = a if right is None else blocks(right)
    ids = lambda df, name: df.select(F.col("at").alias(name), *[F.col(f"at.{c}").alias(c) for c in [*by, *key]])
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s_{d}") for s, d in zip(step, dims)]) for step in product((-1, 0, 1), repeat=len(dims))])
    near = ids(b, "b_at").withColumn("s", F.explode(shifts)).select("b_at", *by, *[(F.col(g) + F.col(f"s.s_{d}")).alias(g) for d, g in zip(dims, key)])
    met = ids(a, "a_at").join(near, [*by, *key]).select("a_at", "b_at")
    if right is None:
        met = met.where(F.col("a_at") <= F.col("b_at"))
    met = met.join(a.select(F.col("at").alias("a_at"), *[F.col(f"c_{c}").alias(f"a_{c}") for c in left.columns]), "a_at")
    met = met.join(b.select(F.col("at").alias("b_at"), *[F.col(f"c_{c}").alias(f"b_{c}") for c in (left if right is None else right).columns]), "b_at")
    met = met.withColumn("same", (F.col("a_at") == F.col("b_at")) if right is None else F.lit(False))
    empty = None

    def run(table: pa.Table) -> pa.Table:
        same = table["same"][0].as_py()
        take = lambda side: {c[2:]: table[c][0].values.to_numpy(zero_copy_only=False) for c in table.column_names if c.startswith(side) and c[2:] != "at"}
        x = take("a_")
        out = found(x, x if same else take("b_"), same)
        return empty if out is None else pa.Table.from_batches([out])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return spread(met, "a_at", "b_at").groupBy("a_at", "b_at").applyInArrow(run, schema)


def distances(a: Block, b: Block, dims: list[str]) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of ``a`` at a time, with their squared distances to all of ``b``."""
    n = len(a[dims[0]])
    step = max(1, AT_ONCE // max(1, len(b[dims[0]])))
    for lo in range(0, n, step):
        d2 = None
        for d in dims:
            gap = a[d][lo : lo + step, None] - b[d][None, :]
            gap *= gap
            d2 = gap if d2 is None else np.add(d2, gap, out=d2)
        yield slice(lo, min(n, lo + step)), d2


def bound(test: Callable[[np.float64], bool]) -> float:
    """The largest double from 0 up that passes a test which holds up to some number and not beyond; -1 if none does."""
    if not test(np.float64(0.0)):
        return -1.0
    lo, hi = 0, int(np.float64(np.finfo(float).max).view(np.int64))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if test(np.int64(mid).view(np.float64)) else (lo, mid - 1)
    return float(np.int64(lo).view(np.float64))


def within(radius: float) -> float:
    """The largest squared distance whose root is at most ``radius``."""
    return bound(lambda s: bool(np.sqrt(s) <= radius))


def histogram(points: DataFrame, dims: list[str], ends: list[float], radius: float, n_labels: int, by: list[str] | None = None) -> DataFrame:
    """(by..., label_src, label_dst, bin, n): ordered pairs, a point with itself included, whose squared distance is above ends[bin] and
    at most ends[bin + 1]. ``label``: numbers from 0.
    """
    by = by or []
    size = len(ends) - 1

    def count(a: Block, b: Block, same: bool) -> pa.RecordBatch:
        sums = np.zeros(n_labels * n_labels * size, np.int64)
        for rows, d2 in distances(a, b, dims):
            hit = (d2 > ends[0]) & (d2 <= ends[-1])
            labels = (a["label"][rows].astype(np.int64)[:, None] * n_labels + b["label"].astype(np.int64)[None, :])[hit]
            bins = np.searchsorted(ends, d2[hit], "left") - 1
            sums += np.bincount(labels * size + bins, minlength=len(sums))
        cube = sums.reshape(n_labels, n_labels, size)
        if not same:
            cube = cube + cube.transpose(1, 0, 2)
        i, j, k = np.nonzero(cube)
        own = [pa.array(np.full(len(i), a[c][0])) for c in by]
        return pa.RecordBatch.from_arrays([*own, pa.array(i), pa.array(j), pa.array(k), pa.array(cube[i, j, k])], names=[*by, "label_src", "label_dst", "bin", "n"])

    made = block_pairs(points.select(*by, "label", *dims), None, radius, dims, count, ", ".join(f"{c} long" for c in [*by, "label_src", "label_dst", "bin", "n"]), by)
    return made.groupBy(*by, "label_src", "label_dst", "bin").agg(F.sum("n").alias("n"))


def forest(points: DataFrame, dims: list[str], radius: float) -> DataFrame:
    """(src, dst): pairs within the radius that connect what all such pairs connect, at most as many for two blocks as they have points."""
    most = within(radius)

    def grow(a: Block, b: Block, same: bool) -> pa.RecordBatch | None:
        part, out = np.arange(len(b["cell_id"])), []
        for rows, d2 in distances(a, b, dims):
            close = d2 <= most
            for i in np.flatnonzero(close.any(axis=1)):
                hit = np.flatnonzero(close[i])
                parts, first = np.unique(part[hit], return_index=True)
                out.append((np.full(len(parts), a["cell_id"][rows.start + i]), b["cell_id"][hit[first]]))
                if len(parts) > 1:
                    part[np.isin(part, parts)] = parts[0]
        if not out:
            return None
        src, dst = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(src[src != dst]), pa.array(dst[src != dst])], names=["src", "dst"])

    return block_pairs(points.select(F.col("cell_id").cast("long").alias("cell_id"), *dims), None, radius, dims, grow, "src long, dst long")


def nearest_within(points: DataFrame, dims: list[str], radius: float, k: int, slack: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(src, dst, distance): of the pairs at 0 < distance <= radius, for each point and pair of blocks the ``k`` nearest, and what is not
    further than ``slack`` of the squared distance of the last of them.
    """
    most = within(radius)

    def choose(a: Block, b: Block, same: bool) -> pa.RecordBatch | None:
        out = []
        for x, y in [(a, b)] if same else [(a, b), (b, a)]:
            for rows, d2 in distances(x, y, dims):
                d2[(d2 > most) | (d2 <= 0)] = np.inf
                last = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(d2), np.inf)
                i, j = np.nonzero((d2 <= slack(last)[:, None]) & np.isfinite(d2))
                out.append((x["cell_id"][rows][i], y["cell_id"][j], np.sqrt(d2[i, j])))
        src, dst, distance = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(distance)], names=["src", "dst", "distance"])

    return block_pairs(points.select(F.col("cell_id").cast("long").alias("cell_id"), *dims), None, radius, dims, choose, "src long, dst long, distance double")


def directions(at: DataFrame, of: DataFrame, radius: float) -> DataFrame:
    """(cell_id, x, y, mx, my, total) of points ``at`` (cell_id, x, y, value): means and sum over the points ``of`` within the radius, but
    for itself, of the unit vector between them, from ``of`` to ``at``, times both values; points without any are left out.
    """
    most = within(radius)
    columns = ["cell_id", "x", "y", "value"]

    def add(a: Block, b: Block, same: bool) -> pa.RecordBatch:
        out = np.zeros((4, len(a["x"])))
        for rows, d2 in distances(a, b, ["x", "y"]):
            hit = (d2 <= most) & (a["cell_id"][rows, None] != b["cell_id"][None, :])
            one = np.where(hit & (d2 > 0), 1 / np.sqrt(np.where(d2 > 0, d2, 1)), 0.0)
            for k, d in enumerate("xy"):
                out[k, rows] = ((a[d][rows, None] - b[d][None, :]) * one) @ b["value"]
            out[2, rows], out[3, rows] = hit @ b["value"], hit.sum(axis=1)
        some = out[3] > 0
        return pa.RecordBatch.from_arrays([pa.array(a[c][some]) for c in columns] + [pa.array(o[some]) for o in out], names=[*columns, "sx", "sy", "s", "k"])

    at, of = (df.select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in columns[1:]]) for df in (at, of))
    made = block_pairs(at, of, radius, ["x", "y"], add, "cell_id long, x double, y double, value double, sx double, sy double, s double, k double")
    mean = lambda c: F.col("value") * F.sum(c) / F.sum("k")
    return made.groupBy(*columns).agg(mean("sx").alias("mx"), mean("sy").alias("my"), (F.col("value") * F.sum("s")).alias("total")).drop("value")


def talk(points: DataFrame, radius: float, n_types: int, proteins: int, totals: bool) -> DataFrame:
    """(kind, i, j, k, n, total) of ordered pairs within the radius of different types (``t``, from 0): of kind 0 the pairs of types i and
    j, of kind 1 those of them that send (bits ``s``) and take (bits ``r``) protein k, with the sum of the products of e_k and v_k if
    ``totals``, of kind 2 the word j of type numbers, as bits k, that cell i has beside it.
    """
    most = within(radius)

    def side(x: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        types = (x["t"][:, None] == np.arange(n_types)).astype(np.float32)
        bits = lambda c: ((x[c].astype(np.int64)[:, None] >> np.arange(proteins)) & 1).astype(np.float32)
        return types, bits("s"), bits("r")

    def count(a: Block, b: Block, same: bool) -> pa.RecordBatch:
        pairs, comm, total = np.zeros((n_types, n_types)), np.zeros((n_types, proteins, n_types)), np.zeros((n_types, proteins, n_types))
        touched = []
        for x, y in [(a, b)] if same else [(a, b), (b, a)]:
            (tx, sx, _), (ty, _, ry) = side(x), side(y)
            takes = np.concatenate([ty] + [ty * ry[:, [p]] for p in range(proteins)], axis=1)
            valued = np.concatenate([ty * y[f"v_{p}"][:, None] for p in range(proteins)], axis=1) if totals else None
            beside = np.zeros((len(x["t"]), n_types), bool)
            for rows, d2 in distances(x, y, ["x", "y"]):
                close = (d2 <= most) & (x["t"][rows, None] != y["t"][None, :])
                got = (close.astype(np.float32) @ takes).astype(float)  # whole numbers up to the size of a block
                beside[rows] = got[:, :n_types] > 0
                own = tx[rows].astype(float)
                pairs += own.T @ got[:, :n_types]
                weighed = close.astype(float) @ valued if totals else None
                for p in range(proteins):
                    cols = slice((p + 1) * n_types, (p + 2) * n_types)
                    comm[:, p] += (own * sx[rows, p, None]).T @ got[:, cols]
                    if totals:
                        total[:, p] += (own * x[f"e_{p}"][rows, None]).T @ weighed[:, p * n_types : (p + 1) * n_types]
            for word in range(-(-n_types // 62)):
                some = beside[:, word * 62 : (word + 1) * 62]
                mask = (some.astype(np.int64) << np.arange(some.shape[1])).sum(axis=1)
                touched.append((x["cell_id"][mask > 0], np.full((mask > 0).sum(), word), mask[mask > 0]))
        i, j = np.nonzero(pairs)
        k, p, m = np.nonzero((comm > 0) | (total != 0))
        cells, words, masks = (np.concatenate(c) for c in zip(*touched))
        kind = np.repeat([0, 1, 2], [len(i), len(k), len(cells)])
        zeros = np.zeros(len(cells))
        cols = [kind, np.r_[i, k, cells], np.r_[j, m, words], np.r_[np.zeros(len(i), np.int64), p, masks], np.r_[pairs[i, j], comm[k, p, m], zeros].astype(np.int64), np.r_[np.zeros(len(i)), total[k, p, m], zeros]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "i", "j", "k", "n", "total"])

    return block_pairs(points, None, radius, ["x", "y"], count, "kind long, i long, j long, k long, n long, total double")
