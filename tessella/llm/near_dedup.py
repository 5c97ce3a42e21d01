"""SimHash near-dedup with vantage-point trees.

A text's fingerprint is the 128-bit SimHash of its distinct words. Two documents are near copies if their
fingerprints differ in at most ``radius`` bits and the smaller count of distinct words is at least ``ratio`` times
the larger. A tree whose nodes split by a measure that near copies almost share (Hamming distance to a vantage
point, or log word count) shards the fingerprints: one on the near side of a split also visits the far side if the
triangle bound lets it have a partner there. Each pair meets in exactly one shard. There fingerprints are cut into
blocks of bits with a radius each; a pair within the whole radius is within that of a block at least, so only pairs
whose blocks' values are that near are tested, exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import col, columns, draw, fresh, sized, stage

RADIUS = 24
RATIO = 0.8
#: Fingerprints drawn to place the splits; they decide on the shards' sizes, not on results.
SAMPLE = 20_000
SHARD = 200_000
#: Fingerprints of a shard, at least, while there are enough shards for the cores.
LEAST_SHARD = 5_000
#: Pairs of a shard from which blocks cost less than testing them all.
DENSE = 3_000_000_000
#: Pairs found that are held before they are counted and joined to groups.
HELD = 1_000_000
#: Members of a group of equal fingerprints that are listed in one row, about.
LIST = 256
_WORD = re.compile(r"\w+")
_MEMO = 400_000


class _Digests:
    """128-bit digests of words, kept for the words seen of late."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.empty((1024, 16), np.uint8)

    def rows(self, words: set[str]) -> np.ndarray:
        at = self.at
        if len(at) + len(words) > _MEMO:
            at.clear()
        for w in words:
            if w not in at:
                i = at[w] = len(at)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[i] = np.frombuffer(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")), np.uint8)
        return self.table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


def simhash(text: str, digests: _Digests) -> tuple[int, int, int]:
    """(distinct words, first half, second half) of a text; halves as signed 64-bit numbers."""
    words = set(_WORD.findall(text.lower()))
    if not words:
        return 0, 0, 0
    ones = np.zeros(128, np.int64)
    rows = digests.rows(words)
    for lo in range(0, len(rows), 255):
        ones += np.add.reduce(np.unpackbits(rows[lo : lo + 255], axis=1), axis=0, dtype=np.uint8)
    f = np.packbits(2 * ones > len(words)).view(np.int64)
    return len(words), int(f[0]), int(f[1])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests = _Digests()
    for b in batches:
        got = [simhash(t or "", digests) for t in b.column(2).to_pylist()]
        cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "h", "n", "f0", "f1"])


def _documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, h: hash of the text, n: distinct words, f0, f1), staged; h is null and n is 0 for a null text. Without null ids."""
    rows = docs.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("doc_id"), F.when(col(text).isNotNull(), F.xxhash64(col(text))).alias("h"), col(text).alias("text"))
    return stage(rows.mapInArrow(_prints, "doc_id long, h long, n int, f0 long, f1 long"), "fingerprints")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h: hash of the text, n: distinct words, f0, f1), staged; without null ids and texts that have no word."""
    return _documents(docs, id_col, text).where("n > 0")


def hamming(a0: np.ndarray, a1: np.ndarray, b0, b1) -> np.ndarray:
    return _ones(a0 ^ b0).astype(np.int16) + _ones(a1 ^ b1)


def _ones(x: np.ndarray) -> np.ndarray:
    """Set bits; of signed numbers bitwise_count would take those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


class Tree:
    """Nodes: (kind, vantage point, split, tolerance, left, right) or a shard's number."""

    def __init__(self, n: np.ndarray, f0: np.ndarray, f1: np.ndarray, shards: int, radius: int, ratio: float) -> None:
        self.radius, self.slack, self.shards = radius, -math.log(ratio) + 1e-9, 0
        self.rng = np.random.default_rng(7)
        self.root = self._grow(np.log(np.maximum(n, 1)), f0, f1, max(1, len(n) / max(1, shards)))

    def _grow(self, ln: np.ndarray, f0: np.ndarray, f1: np.ndarray, most: float):
        if len(ln) > most:
            options = [("n", None, ln, self.slack)]
            for i in self.rng.choice(len(ln), min(3, len(ln)), replace=False):
                options.append(("v", (f0[i], f1[i]), hamming(f0, f1, f0[i], f1[i]).astype(float), float(self.radius)))
            best = None
            for kind, point, x, slack in options:
                cut = float(np.median(x))
                left = x <= cut
                if left.all():
                    cut = float(np.max(x[x < cut], initial=-np.inf))
                    left = x <= cut
                if not left.any():
                    continue
                # what is held or visits on the right, and what is held on the left: less is better
                cost = max(left.sum(), (x > cut - slack).sum())
                if best is None or cost < best[0]:
                    best = (cost, kind, point, cut, slack, left)
            if best:
                _, kind, point, cut, slack, left = best
                return kind, point, cut, slack, self._grow(ln[left], f0[left], f1[left], most), self._grow(ln[~left], f0[~left], f1[~left], most)
        self.shards += 1
        return self.shards - 1

    def route(self, n: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): each row's own shard and those that it visits."""
        ln = np.log(np.maximum(n, 1))
        out: list[tuple[np.ndarray, int, bool]] = []

        def go(node, own: np.ndarray, visits: np.ndarray) -> None:
            if not len(own) and not len(visits):
                return
            if not isinstance(node, tuple):
                out.extend([(own, node, True), (visits, node, False)])
                return
            kind, point, cut, slack, left, right = node
            x, y = ((ln[r] if kind == "n" else hamming(f0[r], f1[r], *point)) for r in (own, visits))
            go(left, own[x <= cut], visits[y <= cut + slack])
            go(right, own[x > cut], np.concatenate([own[(x <= cut) & (x >= cut - slack)], visits[y >= cut - slack]]))

        go(self.root, np.arange(len(n)), np.empty(0, np.int64))
        rows = [(r, np.full(len(r), s), np.full(len(r), h)) for r, s, h in out if len(r)]
        return tuple(np.concatenate(x) for x in zip(*rows)) if rows else (np.empty(0, int), np.empty(0, int), np.empty(0, bool))


def _blocks(radius: int, pairs: float) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of blocks, for pairs within ``radius``: in one of them at least they are within its radius.

    The blocks' radii plus one sum up to ``radius`` plus one. The more pairs there are, the longer are the blocks, as
    more values leave fewer pairs to test. Few pairs, or a radius at which blocks tell little, take one block without bits.
    """
    if pairs >= DENSE:
        m = 12 if pairs < 20 * DENSE else 10 if pairs < 200 * DENSE else 8
        ends = [128 * i // m for i in range(m + 1)]
        blocks = sorted(((lo, hi - lo) for lo, hi in zip(ends, ends[1:])), key=lambda x: -x[1])
        near = [(radius + 1) // m - 1 + (i < (radius + 1) % m) for i in range(m)]
        if max(near) <= 3:
            return [(lo, bits, r) for (lo, bits), r in zip(blocks, near) if r >= 0]
    return [(0, 0, 0)]


def _value(f0: np.ndarray, f1: np.ndarray, lo: int, bits: int) -> np.ndarray:
    """The block's bits as a number; blocks don't cross the halves."""
    f, lo = (f0, lo) if lo < 64 else (f1, lo - 64)
    return (f >> np.uint64(lo)) & np.uint64((1 << bits) - 1)


def _flips(bits: int, radius: int) -> np.ndarray:
    x = np.arange(1 << bits, dtype=np.uint64)
    return x[np.bitwise_count(x) <= radius].astype(np.int64)


def _near(n: np.ndarray, f0: np.ndarray, f1: np.ndarray, home: np.ndarray, radius: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of near pairs, of home rows among themselves and with guests, each once."""
    many = int(home.sum())
    blocks = _blocks(radius, many * (len(n) - many / 2))
    f0, f1 = f0.view(np.uint64), f1.view(np.uint64)
    bits_of, ones, more = np.empty((64, 4096), np.uint64), np.empty((64, 4096), np.uint8), np.empty((64, 4096), np.uint8)

    def within(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
        x, y, z = bits_of[: len(a0), : len(b0)], ones[: len(a0), : len(b0)], more[: len(a0), : len(b0)]
        np.bitwise_count(np.bitwise_xor(a0[:, None], b0, out=x), out=y)
        np.bitwise_count(np.bitwise_xor(a1[:, None], b1, out=x), out=z)
        return np.divmod(np.flatnonzero(np.add(y, z, out=y) <= radius), len(b0))

    for k, (lo, bits, r) in enumerate(blocks):
        value, flips = _value(f0, f1, lo, bits).astype(np.int64), _flips(bits, r)
        rows = np.lexsort((n, ~home, value))  # of a value first home rows, then guests
        first = np.searchsorted(value[rows], np.arange((1 << bits) + 1))
        guests = first[:-1] + np.bincount(value[home], minlength=1 << bits)
        g0, g1 = f0[rows], f1[rows]
        for v in np.flatnonzero(guests > first[:-1]):
            w = flips ^ v
            lo_at = np.where(w >= v, first[w], guests[w])  # home rows of lesser values have met these already
            sizes = first[w + 1] - lo_at
            c = np.repeat(lo_at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            c0, c1 = g0[c], g1[c]
            for s in range(first[v], guests[v], 64):
                own = slice(s, min(s + 64, guests[v]))
                for t in range(0, len(c), 4096):
                    i, j = within(g0[own], g1[own], c0[t : t + 4096], c1[t : t + 4096])
                    if not len(i):
                        continue
                    i, j = rows[s + i], rows[c[t + j]]
                    ok = (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]) - 1e-9) & (~home[j] | (value[j] != v) | (i < j))
                    i, j = i[ok], j[ok]
                    for at, width, near in blocks[:k]:  # an earlier block has found those
                        new = np.bitwise_count(_value(f0[i], f1[i], at, width) ^ _value(f0[j], f1[j], at, width)) > near
                        i, j = i[new], j[new]
                    if len(i):
                        yield i, j, hamming(f0[i], f1[i], f0[j], f1[j])


def _search(radius: int, ratio: float):
    def search(t: pa.Table) -> pa.Table:
        ids, h, n, f0, f1, home = (t[c].to_numpy() for c in ("doc_id", "h", "n", "f0", "f1", "home"))
        found = list(_near(n, f0, f1, home, radius, ratio))
        i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        turn = (ids[i] > ids[j]) | ((ids[i] == ids[j]) & (h[i] > h[j]))
        a, b = np.where(turn, j, i), np.where(turn, i, j)
        return pa.table({"doc_a": ids[a], "h_a": h[a], "doc_b": ids[b], "h_b": h[b], "distance": d.astype(np.int32)})

    return search


class _Groups:
    """Links and connected groups of rows, from pairs that come in turn and are not kept."""

    def __init__(self, texts: np.ndarray) -> None:
        self.texts, self.links, self.lead = texts, np.zeros(len(texts), np.int64), np.arange(len(texts))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in ((i, j), (j, i)):
            self.links += np.bincount(x, self.texts[y], len(self.texts)).astype(np.int64)
        lead = self.lead
        while True:
            a, b = lead[i], lead[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
            while (lead != lead[lead]).any():
                lead = lead[lead]
        self.lead = lead


def _gather(radius: int, ratio: float):
    """A shard's rows that have near ones in it: how many documents those are, and one row that all of a group have in common."""

    def gather(t: pa.Table) -> pa.Table:
        ids, h, n, f0, f1, texts, home = (t[c].to_numpy() for c in ("doc_id", "h", "n", "f0", "f1", "texts", "home"))
        groups, held, many = _Groups(texts), [], 0
        for i, j, _ in _near(n, f0, f1, home, radius, ratio):
            held.append((i, j))
            many += len(i)
            if many >= HELD:
                groups.add(*(np.concatenate(x) for x in zip(*held)))
                held, many = [], 0
        if held:
            groups.add(*(np.concatenate(x) for x in zip(*held)))
        at = np.flatnonzero(groups.links)
        to = groups.lead[at]
        return pa.table({"doc_id": ids[at], "h": h[at], "to_id": ids[to], "to_h": h[to], "links": groups.links[at]})

    return gather


def shards_for(total: int, partitions: int, cores: int) -> int:
    """Shards follow the cores and their size, not the shuffle's partitions: a row visits a share of all shards."""
    return max(1, -(-total // SHARD), min(partitions, 4 * cores, total // LEAST_SHARD))


def _routed(prints: DataFrame, radius: int, ratio: float) -> tuple[DataFrame, GroupedData]:
    """Fingerprints (n, f0, f1, doc_id and h: the least document, texts: how many), and their rows by shard.

    A document is an id with a text, as an id may come with several texts.
    """
    spark = prints.sparkSession
    each = prints.select("n", "f0", "f1", F.struct("doc_id", "h").alias("doc")).groupBy("n", "f0", "f1")
    unique = each.agg(F.min("doc").alias("doc"), F.count_distinct("doc").alias("texts")).select("n", "f0", "f1", "doc.doc_id", "doc.h", "texts")
    unique = stage(unique, "unique")
    total = unique.count()
    drawn = draw(unique.select("n", "f0", "f1"), total, SAMPLE, "f0", "f1", "n").toPandas()
    shards = shards_for(total, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tree = Tree(drawn["n"].to_numpy(), drawn["f0"].to_numpy(), drawn["f1"].to_numpy(), shards, radius, ratio)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, shard, home = tree.route(*(b.column(i).to_numpy() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(shard.astype(np.int32)), pa.array(home.astype(bool))], names=["doc_id", "h", "n", "f0", "f1", "texts", "shard", "home"])

    schema = "doc_id long, h long, n int, f0 long, f1 long, texts long, shard int, home boolean"
    routed = unique.select("doc_id", "h", "n", "f0", "f1", "texts").mapInArrow(route, schema)
    # a number of partitions of its own keeps small shards from being put into few tasks
    return unique, routed.repartition(4 * tree.shards, "shard").groupBy("shard")


def _met(prints: DataFrame, radius: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Fingerprints as ``_routed`` has them, and the near pairs of their least documents."""
    unique, shards = _routed(prints, radius, ratio)
    return unique, shards.applyInArrow(_search(radius, ratio), "doc_a long, h_a long, doc_b long, h_b long, distance int")


def classes_of(prints: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, h, class_id, class_h, links) of each document of staged fingerprints; see ``classes``."""
    unique, shards = _routed(prints, radius, ratio)
    met = stage(shards.applyInArrow(_gather(radius, ratio), "doc_id long, h long, to_id long, to_h long, links long"), "met")
    ends = met.where("doc_id <> to_id or h <> to_h").select(F.struct("doc_id", "h").alias("a"), F.struct(F.col("to_id").alias("doc_id"), F.col("to_h").alias("h")).alias("b"))
    lead = groups_of(ends, "a", "b").select("doc.doc_id", "doc.h", F.col("leader.doc_id").alias("class_id"), F.col("leader.h").alias("class_h"))
    links = met.groupBy("doc_id", "h").agg(F.sum("links").alias("links")).join(lead, ["doc_id", "h"])
    reps = unique.join(links, ["doc_id", "h"], "left")
    reps = reps.select("n", "f0", "f1", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_h", "h").alias("class_h"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links"))
    return prints.distinct().join(reps, ["n", "f0", "f1"]).select("doc_id", "h", "class_id", "class_h", "links")


def pairs_of(prints: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_a, h_a, doc_b, h_b, distance): pairs of documents that connect all near copies of staged fingerprints; see ``near_pairs``."""
    unique, found = _met(prints, radius, ratio)
    same = unique.where("texts > 1").select("n", "f0", "f1", F.col("doc_id").alias("doc_a"), F.col("h").alias("h_a"))
    members = prints.join(same, ["n", "f0", "f1"]).where("doc_id <> doc_a or h <> h_a")
    return found.unionAll(members.select("doc_a", "h_a", F.col("doc_id").alias("doc_b"), F.col("h").alias("h_b"), F.lit(0).alias("distance")).distinct())


def all_pairs_of(prints: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """All near pairs of staged fingerprints; see ``all_pairs``."""
    unique, found = _met(prints, radius, ratio)
    same = unique.where("texts > 1").select("n", "f0", "f1", F.col("doc_id").alias("rep"), F.col("h").alias("rep_h"), F.ceil(F.col("texts") / LIST).alias("lists"))
    lists = prints.join(same, ["n", "f0", "f1"]).groupBy("rep", "rep_h", F.pmod(F.xxhash64("doc_id"), "lists").alias("part")).agg(F.collect_set("doc_id").alias("ids"))
    lists = stage(lists, "lists")
    x, y = (lists.select(F.col("rep").alias(f"doc_{c}"), F.col("rep_h").alias(f"h_{c}"), F.col("part").alias(f"part_{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
    near = found.join(x, ["doc_a", "h_a"], "left").join(y, ["doc_b", "h_b"], "left")
    key = ["doc_a", "h_a", "part_a", "doc_b", "h_b", "part_b"]
    near = near.select(*key, "distance", F.coalesce("ids_a", F.array("doc_a")).alias("ids_a"), F.coalesce("ids_b", F.array("doc_b")).alias("ids_b"))
    equal = x.join(y, (F.col("doc_a") == F.col("doc_b")) & (F.col("h_a") == F.col("h_b"))).where("part_a <= part_b")
    equal = equal.select(*key, F.lit(0).alias("distance"), "ids_a", "ids_b")
    # the lists of a large group are dealt to tasks before they are multiplied
    dealt = near.unionAll(equal).repartition(*key)
    twice = (F.col("doc_a") == F.col("doc_b")) & (F.col("h_a") == F.col("h_b")) & (F.col("part_a") == F.col("part_b"))
    each = dealt.select("distance", "ids_b", twice.alias("twice"), F.explode("ids_a").alias("a")).select("distance", "twice", "a", F.explode("ids_b").alias("b"))
    each = each.where((F.col("a") < F.col("b")) | (~F.col("twice") & (F.col("a") > F.col("b"))))
    return each.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "distance")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_a, doc_b, distance): pairs that connect all near copies, doc_a <= doc_b, exact for the fingerprints.

    Documents with equal fingerprints and word counts are paired with the least id among them only, which stands for
    all of them in the other pairs; so a group of n copies takes n - 1 rows. Rows with a null id or text, and texts
    without a word, are in no pair. A repeated row is one document; an id of several texts is as many documents, and
    two of them that are near give a pair of equal ids. An empty table gives no pairs.
    """
    return pairs_of(fingerprints(docs, id_col, text), radius, ratio).select("doc_a", "doc_b", "distance")


def all_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_a, doc_b, distance): all pairs of near copies, doc_a < doc_b, exact for the fingerprints.

    A group of n copies takes n(n - 1)/2 rows, and each of them has its own pairs with near copies. Rows with a null
    id or text, and texts without a word, are in no pair. A repeated row is one document; an id of several texts has
    the pairs of each (one where their fingerprints are equal), but none with itself. An empty table gives no pairs.
    """
    return all_pairs_of(fingerprints(docs, id_col, text), radius, ratio)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, class_id, links, text_hash, class_text_hash): a row for each document, an id with a text.

    A class is what pairs of near copies connect; it has the id and the text's hash of its least document. ``links``
    counts the other documents that are near copies of this one, exact for the fingerprints, so half of its sum is the
    number of all pairs. A text without a word, or a null one, is a class by itself; its hash is null if it is null. A
    repeated row is one document, and rows with a null id are none. An empty table gives no rows.
    """
    every = _documents(docs, id_col, text)
    alone = every.where("n = 0").select("doc_id", "h").distinct().selectExpr("doc_id", "h", "doc_id AS class_id", "h AS class_h", "0L AS links")
    found = classes_of(every.where("n > 0"), radius, ratio).unionByName(alone)
    return found.selectExpr("doc_id", "class_id", "links", "h AS text_hash", "class_h AS class_text_hash")


def groups_of(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc, leader): every end of ``pairs`` with the least one that is connected to it. Ends may be structs.

    Labels spread along edges that are contracted to the labels themselves, until no label changes.
    """
    edges = stage(pairs.select(col(a).alias("a"), col(b).alias("b")), "edges")
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("leader")), "labels")
    while True:
        hop = labels.select(F.col("a").alias("b"), F.col("leader").alias("seen"))
        least = both.join(hop, "b").groupBy("a").agg(F.min("seen").alias("near"))
        up = labels.select(F.col("a").alias("leader"), F.col("leader").alias("above"))
        moved = labels.join(least, "a").join(up, "leader").select("a", F.least("leader", "near", "above").alias("new"), "leader")
        moved = stage(moved, "labels")
        if moved.where("new <> leader").isEmpty():
            return moved.select(F.col("a").alias("doc"), "leader")
        labels = moved.select("a", F.col("new").alias("leader"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the least id, and of its texts the least hash.

    A group is what pairs connect. A document is an id with a text: a text that is no near copy stays whatever others
    have its id. Of rows that repeat an id and a text one stays. Rows with a null id or text, or a text without a
    word, all stay. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    prints = fingerprints(docs, id_col, text)
    id_c, h_c, rn = fresh(docs, "id", "h", "rn")
    key = [F.col("doc_id").alias(id_c), F.col("h").alias(h_c)]
    gone = stage(classes_of(prints, radius, ratio).where("doc_id <> class_id or h <> class_h").select(*key), "gone")
    own = (col(id_col) == F.col(id_c)) & (F.xxhash64(col(text)) == F.col(h_c))
    kept = docs.join(sized(gone), own, "left_anti")
    again = stage(prints.groupBy("doc_id", "h").count().where("count > 1").select(*key), "repeated")
    if again.isEmpty():
        return kept
    again = sized(again)
    one = Window.partitionBy(col(id_col), col(text)).orderBy(F.lit(0))
    hit = kept.join(again, own, "left_semi").withColumn(rn, F.row_number().over(one)).where(F.col(rn) == 1)
    return kept.join(again, own, "left_anti").unionAll(hit.select(columns(docs)))
