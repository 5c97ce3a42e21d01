"""Best-fit packing after Martello-Toth dominance reduction.

Documents are dealt by a hash of their id to shards that are packed on their own. A shard is a multiset of piece
sizes. The reduction takes sizes from the largest down and closes a bin at once where one small set of pieces
provably does at least as well as any other set with that piece; best-fit decreasing packs what remains.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, word_count

CAPACITY = 2048
#: Pieces that a shard holds on average.
SHARD = 50_000


def reduce_and_fit(sizes: Counter, capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """(sizes of a bin, how many such bins, whether the reduction fixed them) for a multiset of sizes up to ``capacity``."""
    left = Counter({s: n for s, n in sizes.items() if n})
    order = sorted(left)
    bins: list[tuple[tuple[int, ...], int, bool]] = []

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            order.pop(bisect_left(order, size))

    def give(size: int) -> None:
        if not left[size]:
            insort(order, size)
        left[size] += 1

    def largest(room: int) -> int | None:
        i = bisect_right(order, room)
        return order[i - 1] if i else None

    def second_above(size: int) -> int | None:
        """The sum of the two least pieces that are larger than ``size``."""
        i = bisect_right(order, size)
        if i == len(order):
            return None
        if left[order[i]] > 1:
            return 2 * order[i]
        return order[i] + order[i + 1] if i + 1 < len(order) else None

    def dominating(s: int) -> tuple[int, ...] | None:
        """The pieces beside one of this size, itself taken out, if they can stand in for any other set beside it."""
        room = capacity - s
        one = largest(room)
        if one is None:  # nothing fits
            return ()
        two = second_above(0)
        if one == room or two is None or two > room:  # a perfect pair, or only one piece fits: then the largest
            return (one,)
        three = _third(left, order)
        if three is not None and three <= room:
            return None
        # at most two pieces fit
        if one >= _best_pair(left, order, room):
            return (one,)
        take(one, 1)
        other = largest(room - one)
        give(one)
        if other is None:
            return None
        pair = second_above(other)
        # of any two that fit, the larger is at most one; if there are no two above other, the smaller is at most that
        return (one, other) if pair is None or pair > room else None

    def close(s: int) -> bool:
        """Closes bins with pieces of this size as long as a set dominates."""
        done = False
        while left[s]:
            take(s, 1)
            beside = dominating(s)
            if beside is None:
                give(s)
                break
            for x in beside:
                take(x, 1)
            n = 1
            if not beside and left[s]:
                n += left[s]
                take(s, left[s])
            bins.append(((s, *beside), n, True))
            done = True
        return done

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            changed |= close(s)
    bins.extend((b, n, False) for b, n in _best_fit(left, capacity).items())
    return bins


def _third(left: Counter, order: list[int]) -> int | None:
    """The sum of the three least pieces."""
    need, total = 3, 0
    for s in order[:3]:
        n = min(need, left[s])
        need, total = need - n, total + n * s
    return None if need else total


def _best_pair(left: Counter, order: list[int], room: int) -> int:
    """The largest sum within ``room`` of two pieces."""
    best, i, j = 0, 0, bisect_right(order, room) - 1
    while i <= j:
        total = order[j] + order[i]
        if total > room or (i == j and left[order[j]] < 2):
            j -= 1
            continue
        best = max(best, total)
        i += 1
    return best


def _best_fit(items: Counter, capacity: int) -> Counter:
    rooms: list[int] = []
    held: dict[int, list[list[int]]] = defaultdict(list)
    for size in sorted(items, reverse=True):
        for _ in range(items[size]):
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms.pop(at)
                bin_ = held[room].pop()
            else:
                room, bin_ = capacity, []
            bin_.append(size)
            insort(rooms, room - size)
            held[room - size].append(bin_)
    return Counter(tuple(b) for bins in held.values() for b in bins)


def _pack(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        queues: dict[int, list[int]] = {}
        for i, s in enumerate(t["size"].to_pylist()):
            queues.setdefault(s, []).append(i)
        rows, numbers, offsets, fixed = [], [], [], []
        number = 0
        for parts, n, sure in reduce_and_fit(Counter({s: len(q) for s, q in queues.items()}), capacity):
            for _ in range(n):
                offset = 0
                for s in parts:
                    rows.append(queues[s].pop()), numbers.append(number), offsets.append(offset), fixed.append(sure)
                    offset += s
                number += 1
        out = t.take(pa.array(rows, pa.int64()))
        bin_id = (out["shard"].to_numpy().astype(np.int64) << 32) + np.array(numbers, np.int64)
        names = ["bin_id", "doc_id", "piece", "n_tokens", "bin_offset", "fixed"]
        return pa.table([bin_id, out["doc_id"], out["piece"], out["size"], np.array(offsets, np.int64), np.array(fixed, bool)], names=names)

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens, bin_offset, fixed): where every piece of every document goes.

    Tokens are words between white space. A document of more than ``capacity`` tokens is cut into full pieces and a
    rest, numbered from 0, so that no token is lost. No bin exceeds the capacity. ``fixed`` marks bins closed by the
    reduction. Texts without tokens, null ones included, take no room and have no row; rows with a null or repeated
    id are packed like any other. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text)).alias("tokens")).where("tokens > 0")
    sized = stage(sized, "sizes")
    total = sized.agg(F.sum(F.ceil(F.col("tokens") / capacity))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    # spread by the row's values, not its place, so that a task that is run again deals alike
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "tokens")
    dealt = sized.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / capacity).cast("long"))).alias("piece")
    pieces = dealt.select("shard", "doc_id", "tokens", cut).select("shard", "doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("size"))
    schema = "bin_id long, doc_id long, piece long, n_tokens long, bin_offset long, fixed boolean"
    return pieces.groupBy("shard").applyInArrow(_pack(capacity), schema)
