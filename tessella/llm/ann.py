"""Approximate nearest neighbours by cosine, from randomly rotated one-bit codes.

Vectors are dealt to the cells of a coarse quantiser, and in a cell to small sub-cells. The difference to the centre of
its sub-cell is turned by a random rotation and kept as one bit a dimension, with its length and its inner product with
the code as correction. A vector first looks for neighbours in its own cell, which gives it a bar; then it visits the
sub-cells of other cells that are near enough. Inner products are estimated from the bits, and those that the error
bound lets reach the bar are computed exactly. How near is near enough is measured by brute force on sampled queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, draw, stage

K = 10
#: Vectors of a cell and of a sub-cell, on average.
CELL = 8192
SUB = 64
#: Vectors that place each centre, and queries that decide how much is visited.
SAMPLE = 32
PROBES = 200
#: Share of the sampled queries' true neighbours that must lie in the visited cells, and in the visited sub-cells of those.
CELL_COVER = 0.985
COVER = 0.95
#: Standard deviations of the error bound.
EPSILON = 1.9
#: Centres that are compared one and all; more are grouped, and those of the nearest groups are compared.
FLAT = 4096
#: Queries of a cell that a task gets, about.
SLICE = 100_000
#: Sub-cells that set a vector's first bar; one product of a sub-cell if more than one of so many vectors may reach the bar.
NEAREST = 12
DENSE = 12
#: Product with a sub-cell's centre that parts the two rounds in a vector's own cell; it decides on the work only.
HALFWAY = 0.08
#: What float32 may be off by.
SLACK = 1e-5


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _means(x: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit means by label, which labels have members)"""
    order = np.argsort(own, kind="stable")
    some, first = np.unique(own[order], return_index=True)
    s = np.zeros((n, x.shape[1]), np.float32)
    s[some] = np.add.reduceat(x[order], first, axis=0)
    s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)
    full = np.zeros(n, bool)
    full[some] = True
    return s, full


def centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    c = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        new, full = _means(sample, np.argmax(sample @ c.T, axis=1), n)
        c = np.where(full[:, None], new, c)
    return c


class Quantiser:
    """Centres of cells, and the nearest ones of a vector: of all if they are few, else of those of the nearest groups."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.tops = None
        if n <= FLAT:
            self.c = centres(sample, n)
            return
        self.tops = centres(sample, math.isqrt(n))
        own = np.argmax(sample @ self.tops.T, axis=1)
        parts = [centres(m, min(len(m), max(1, round(n * len(m) / len(sample))))) for m in (sample[own == g] for g in range(len(self.tops))) if len(m)]
        self.tops = self.tops[np.unique(own)]
        self.c = np.concatenate(parts)
        self.first = np.cumsum([0, *map(len, parts)])

    def near(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row of ``x``, nearest first; -1 where fewer were looked at."""
        visits = min(visits, len(self.c))
        if self.tops is None:
            return _best(x @ self.c.T, visits)
        widths = np.diff(self.first)
        g = min(len(self.tops), 4 + math.ceil(3 * visits / widths.mean()))
        out = np.empty((len(x), visits), np.int64)
        for lo in range(0, len(x), 512):
            q = x[lo : lo + 512]
            groups = _best(q @ self.tops.T, g)
            score = np.full((len(q), g, widths.max()), -np.inf, np.float32)
            for t in np.unique(groups):
                i, j = np.nonzero(groups == t)
                score[i, j, : widths[t]] = q[i] @ self.c[self.first[t] : self.first[t + 1]].T
            flat = score.reshape(len(q), -1)
            at = _best(flat, min(visits, flat.shape[1]))
            cell = self.first[np.take_along_axis(groups, at // widths.max(), axis=1)] + at % widths.max()
            cell[np.take_along_axis(flat, at, axis=1) == -np.inf] = -1
            out[lo : lo + 512] = -1
            out[lo : lo + 512, : cell.shape[1]] = cell
        return out


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest of each row, largest first."""
    at = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(score), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, axis=1), axis=1, kind="stable"), axis=1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length of the difference to the centre, inner product of its direction with the code). ``centre``: one, or one a row."""
    rest = (x - centre) @ turn
    length = np.linalg.norm(rest, axis=1)
    bits = rest > 0
    align = np.abs(rest).sum(axis=1) / (np.sqrt(x.shape[1]) * np.maximum(length, 1e-12))
    return np.packbits(bits, axis=1), length.astype(np.float32), np.where(length > 1e-12, align, 1.0).astype(np.float32)


def _spread(length: np.ndarray, align: np.ndarray, dims: int) -> np.ndarray:
    """Standard deviation of an estimate for a query at distance 1 from the centre."""
    return length * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, dims - 1))


def estimate(codes: np.ndarray, length: np.ndarray, align: np.ndarray, q: np.ndarray, x_c: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of <x, q> for all coded x and queries q, one row a query, and their error bounds. ``x_c``: <x, centre>."""
    d = len(centre)
    rest = (q - centre) @ turn
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    dot = (rest @ signs.T) / np.sqrt(d) * (length / align)
    base = (q @ centre)[:, None] + x_c[None, :] - centre @ centre
    return dot + base, EPSILON * np.linalg.norm(rest, axis=1)[:, None] * _spread(length, align, d)[None, :]


class Store:
    """The coded vectors of a cell, in order of their sub-cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, sub: np.ndarray, codes: np.ndarray, length: np.ndarray, align: np.ndarray, turn: np.ndarray) -> None:
        order = np.lexsort((ids, sub))
        self.ids, self.x, sub = ids[order], x[order], sub[order]
        length, align, d = length[order], align[order], x.shape[1]
        _, first, own = np.unique(sub, return_index=True, return_inverse=True)
        self.cuts = np.r_[first, len(sub)]
        self.c, _ = _means(self.x, own, len(first))
        self.turn, self.c_turned = turn, self.c @ turn
        signs = np.unpackbits(codes[order], axis=1, count=d).astype(np.float32) * 2 - 1
        # an estimate plus its error is one product: the code, what the centre adds, the spread, and 1 for the query's own part
        base = np.einsum("ij,ij->i", self.x, self.c[own]) - np.einsum("ij,ij->i", self.c, self.c)[own]
        one = np.ones(len(sub), np.float32)
        self.w = np.column_stack([signs * (length / align / np.sqrt(d))[:, None], base, _spread(length, align, d), one]).astype(np.float32)

    def search(self, q: np.ndarray, q_id: np.ndarray, bar: np.ndarray, tau: np.ndarray, k: int, some: tuple[np.ndarray, np.ndarray] | None = None, below: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, similarity) of the k best others of each query at or above its bar, in sub-cells whose centre is at or above its ``tau`` and under ``below``.

        ``some`` (query, place) are compared whatever their estimates.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = [] if some is None else [some]
        turned, score = q @ self.turn, q @ self.c.T
        size = np.einsum("ij,ij->i", self.c, self.c)
        for s, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            at = np.flatnonzero((score[:, s] >= tau) & (score[:, s] < below))
            if not len(at):
                continue
            near = score[at, s]
            far = np.sqrt(np.maximum(1 + size[s] - 2 * near, 0))
            left = np.empty((len(at), q.shape[1] + 3), np.float32)
            np.subtract(turned[at], self.c_turned[s], out=left[:, :-3])
            left[:, -3], left[:, -2], left[:, -1] = 1, EPSILON * far, near
            reach = left @ self.w[lo:hi].T >= bar[at, None]
            if np.count_nonzero(reach) * DENSE > reach.size:  # one product of all is cheaper than many of picked ones
                reach &= q[at] @ self.x[lo:hi].T >= bar[at, None]
                i, j = np.nonzero(reach)
                i, j = at[i], lo + j
            else:
                i, j = np.nonzero(reach)
                i, j = at[i], lo + j
                ok = np.einsum("ij,ij->i", q[i], self.x[j]) >= bar[i]
                i, j = i[ok], j[ok]
            if len(i):
                ok = self.ids[j] != q_id[i]
                found.append((i[ok], j[ok]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, j = (np.concatenate(z) for z in zip(*found))
        if some is not None:
            i, j = np.divmod(np.unique(i * len(self.ids) + j), len(self.ids))
        exact = np.einsum("ij,ij->i", q[i].astype(np.float64), self.x[j].astype(np.float64))
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        start = np.searchsorted(i, i)
        best = np.arange(len(i)) - start < k
        return i[best], j[best], exact[best]

    def some(self, q: np.ndarray, q_id: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """A bar that k others reach for certain, and those others (query, place): the best of the nearest sub-cells."""
        bar, found = np.full(len(q), -np.inf, np.float32), []
        near = np.argmax(q @ self.c.T, axis=1)
        order = _best(self.c @ self.c.T, min(NEAREST, len(self.c)))
        for s in np.unique(near):
            at = np.flatnonzero(near == s)
            few = np.concatenate([np.arange(self.cuts[t], self.cuts[t + 1]) for t in order[s]])
            score = q[at] @ self.x[few].T
            score[q_id[at][:, None] == self.ids[few][None, :]] = -np.inf
            best = _best(score, min(k, len(few)))
            reach = np.take_along_axis(score, best, axis=1)
            if len(few) >= k:
                bar[at] = reach[:, -1] - SLACK
            i, j = np.nonzero(reach > -np.inf)
            found.append((at[i], few[best[i, j]]))
        i, j = (np.concatenate(z) for z in zip(*found))
        return bar, (i, j)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values of sorted rows as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)), pa.array(values))


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int32)


def _build(turn: np.ndarray, dims: int, k: int):
    def build(t: pa.Table) -> pa.Table:
        """Codes of a cell, and the best neighbours that its vectors have in it."""
        t = t.sort_by("vec_id")
        ids, x = t["vec_id"].to_numpy(), _matrix(t["x"], dims)
        n = len(ids)
        subs = -(-n // SUB)
        sample = x[np.random.default_rng(2).choice(n, min(n, 16 * subs), replace=False)]
        sub = np.argmax(x @ centres(sample, subs, 5).T, axis=1)
        mean, _ = _means(x, sub, subs)
        codes, length, align = encode(x, mean[sub], turn)
        store = Store(ids, x, sub, codes, length, align, turn)
        found = []
        for lo in range(0, n, 4096):
            q, q_id = x[lo : lo + 4096], ids[lo : lo + 4096]
            # near sub-cells first: what they give is a higher bar for the rest
            bar, some = store.some(q, q_id, k)
            tau = np.full(len(q), HALFWAY, np.float32)
            i, j, s = store.search(q, q_id, bar, tau, k, some)
            full = np.bincount(i, minlength=len(q)) == k
            bar[full] = s[np.flatnonzero(np.diff(i, append=-1) != 0)][full[np.unique(i)]] - SLACK
            i, j, s = store.search(q, q_id, bar, np.full(len(q), -np.inf), k, (i, j), HALFWAY)
            found.append((i + lo, store.ids[j], s))
        i, j, s = (np.concatenate(z) for z in zip(*found))
        return pa.table(
            {
                "vec_id": t["vec_id"], "cell": t["cell"], "part": t["part"], "sub": pa.array(sub.astype(np.int32)), "code": pa.array([r.tobytes() for r in codes], pa.binary()),
                "length": length, "align": align, "x": t["x"], "ids": _lists(i, n, j), "sims": _lists(i, n, s),
            }
        )

    return build


INDEX = "vec_id long, cell int, part int, sub int, code binary, length float, align float, x array<float>, ids array<long>, sims array<double>"


def _search(turn: np.ndarray, dims: int, k: int):
    def run(queries: pa.Table, stored: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
        if queries.num_rows and stored.num_rows:
            codes = np.frombuffer(b"".join(stored["code"].to_pylist()), np.uint8).reshape(stored.num_rows, -1)
            store = Store(*(stored["vec_id"].to_numpy(), _matrix(stored["x"], dims), stored["sub"].to_numpy(), codes, stored["length"].to_numpy(), stored["align"].to_numpy()), turn)
            ids, x, bar, tau = queries["vec_id"].to_numpy(), _matrix(queries["x"], dims), queries["bar"].to_numpy(), queries["tau"].to_numpy()
            for lo in range(0, len(ids), 4096):
                at = slice(lo, lo + 4096)
                i, j, s = store.search(x[at], ids[at], bar[at], tau[at], k)
                if len(i):
                    some, row = np.unique(i, return_inverse=True)
                    rows.append((ids[at][some], _lists(row, len(some), store.ids[j]), _lists(row, len(some), s)))
        if not rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], names=["vec_id", "ids", "sims"])
        return pa.table([pa.array(np.concatenate([r[0] for r in rows])), pa.concat_arrays([r[1] for r in rows]), pa.concat_arrays([r[2] for r in rows])], names=["vec_id", "ids", "sims"])

    return run


def _targets(x: np.ndarray, own: np.ndarray, few: np.ndarray, quantiser: Quantiser, held: np.ndarray, visits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the ``visits`` nearest cells of every vector, and of those with ``few`` neighbours more, until they hold ``k`` others. ``held``: vectors by cell."""
    near = quantiser.near(x, visits)
    row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    if few.any() and visits < len(quantiser.c):
        at = np.flatnonzero(few)
        order = quantiser.near(x[at], len(quantiser.c))
        others = np.cumsum(np.where(order < 0, 0, held[order]) - (order == own[at][:, None]), axis=1)
        # the cell that fills up k is visited too
        more = np.concatenate([np.ones((len(at), 1), bool), others[:, :-1] < k], axis=1)
        more[:, :visits] = True
        i, j = np.nonzero(more)
        rest = ~few[row]
        row, cell = np.concatenate([row[rest], at[i]]), np.concatenate([cell[rest], order[i, j]])
    return row[cell >= 0], cell[cell >= 0]


def _visited(index: DataFrame, total: int, quantiser: Quantiser, dims: int, k: int) -> tuple[int, float]:
    """(how many of the nearest cells, how near their sub-cells) hold ``COVER`` of the true neighbours of sampled queries, found by brute force."""
    drawn = draw(index.select("vec_id", "x"), total, PROBES, "vec_id").toPandas()
    q, q_id = np.stack(drawn["x"]).astype(np.float32), drawn["vec_id"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = q @ _matrix(b.column(4), dims).T
            s[q_id[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            n = min(k, s.shape[1])
            i, j = np.repeat(np.arange(len(q)), n), _best(s, n).ravel() if n else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *(b.column(c).take(pa.array(j)) for c in (1, 2, 3)), pa.array(s[i, j])], names=["q", "cell", "part", "sub", "s"])

    near = index.select("vec_id", "cell", "part", "sub", "x").mapInArrow(best, "q int, cell int, part int, sub int, s float").where("s > '-Infinity'")
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("rn") <= k).drop("rn", "s").toPandas()
    if not len(top):
        return 1, -np.inf
    key = ["cell", "part", "sub"]
    met = index.sparkSession.createDataFrame(top[key].drop_duplicates())  # at most PROBES k rows

    def mean(t: pa.Table) -> pa.Table:
        c, _ = _means(_matrix(t["x"], dims), np.zeros(t.num_rows, int), 1)
        return pa.table({**{c: t[c].slice(0, 1) for c in key}, "c": _vectors(c)})

    means = index.select(*key, "x").join(F.broadcast(met), key).groupBy(key).applyInArrow(mean, "cell int, part int, sub int, c array<float>").toPandas()
    top = top.merge(means, on=key)
    score = np.einsum("ij,ij->i", q[top["q"]], np.stack(top["c"]))
    order = quantiser.near(q, len(quantiser.c))
    rank = (order[top["q"]] == top["cell"].to_numpy()[:, None]).argmax(axis=1)
    visits = int(np.sort(rank)[math.ceil(CELL_COVER * len(rank)) - 1]) + 1
    inside = np.sort(np.where(rank < visits, score, -np.inf))[::-1]
    return visits, float(inside[math.ceil(COVER * len(inside)) - 1]) - SLACK


def neighbours(embeddings: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): the ``k`` other vectors of highest cosine for every vector.

    Ties go to the lower id. A vector may miss a neighbour in a cell that it doesn't visit, or past the error bound;
    recall is above 0.9. Rows with a null id, a null or empty vector, one that is all zeros or has a null, a NaN or an
    infinite component (as a float), or of another length than the longest common one take no part. Of rows that repeat
    an id, the least vector counts. With k or fewer others there are fewer rows; an empty table gives none.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(col(id_col).cast("long").alias("vec_id"), col(vector).cast("array<float>").alias("x")).where("vec_id is not null and size(x) > 0")
    rows = rows.where("forall(x, v -> v is not null and not isnan(v) and abs(v) < float('Infinity')) and exists(x, v -> v <> 0)")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).orderBy(F.desc("n"), "d").collect()
    if not sizes:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, similarity double")
    dims, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("x") == dims)
    if sizes[0]["ids"] != total:
        rows, total = rows.groupBy("vec_id").agg(F.min("x").alias("x")), sizes[0]["ids"]
    n_cells = -(-total // CELL)
    sample = _unit(np.stack(draw(rows, total, max(2000, n_cells * SAMPLE), "vec_id").toPandas()["x"]))
    quantiser, turn = Quantiser(sample, min(n_cells, len(sample))), rotation(dims)
    n_cells = len(quantiser.c)
    # a cell that would outgrow a task is split by id; its vectors are found in either part
    parts = np.maximum(1, np.ceil(np.bincount(quantiser.near(sample, 1)[:, 0], minlength=n_cells) / len(sample) * total / (2 * CELL)).astype(np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(1), dims))
                cell = quantiser.near(x, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), _vectors(x), pa.array(cell.astype(np.int32)), pa.array(_part(b.column(0).to_numpy(), parts[cell]))], names=["vec_id", "x", "cell", "part"])

    dealt = rows.select("vec_id", "x").mapInArrow(deal, "vec_id long, x array<float>, cell int, part int")
    index = stage(dealt.groupBy("cell", "part").applyInArrow(_build(turn, dims, k), INDEX), "index")
    visits, tau = _visited(index, total, quantiser, dims, k)
    held = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for every CELL vectors
        held[r["cell"]] = r["count"]
    slices = max(1, -(-total * visits // (n_cells * SLICE)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, own, own_part, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dims)
            bar = b.column(4).to_numpy(zero_copy_only=False).astype(np.float32)
            few = np.isnan(bar)
            row, cell = _targets(x, own, few, quantiser, held, visits, k)
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            other = (cell != own[row]) | (part != own_part[row])
            row, cell, part = row[other], cell[other], part[other]
            low = np.where(few, -np.inf, bar - SLACK).astype(np.float32)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(_part(ids[row] + 1, np.full(len(row), slices))), b.column(0).take(at), b.column(3).take(at),
                    pa.array(low[row]), pa.array(np.where(few, -np.inf, tau)[row].astype(np.float32)),
                ],
                names=["cell", "part", "slice", "vec_id", "x", "bar", "tau"],
            )

    bar = F.when(F.size("sims") >= k, F.array_min("sims")).cast("float")
    queries = index.select("vec_id", "cell", "part", "x", bar.alias("bar")).mapInArrow(send, "cell int, part int, slice int, vec_id long, x array<float>, bar float, tau float")
    stored = index.select("cell", "part", "sub", "vec_id", "code", "length", "align", "x").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(int(slices - 1)))))
    key = ["cell", "part", "slice"]
    found = queries.groupBy(key).cogroup(stored.groupBy(key)).applyInArrow(_search(turn, dims, k), "vec_id long, ids array<long>, sims array<double>")
    each = index.select("vec_id", "ids", "sims").unionAll(found).groupBy("vec_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("sims")).alias("sims"))
    pairs = F.zip_with("sims", "ids", lambda s, i: F.struct((-s).alias("away"), i.alias("id")))
    best = each.select("vec_id", F.posexplode(F.slice(F.sort_array(pairs), 1, k)).alias("rank", "p"))
    return best.select("vec_id", F.col("p.id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), (-F.col("p.away")).alias("similarity"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; lengths in float64, which no float32 can overflow."""
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
