"""URL filters by a sorted array of digests.

The rules' 64-bit xxhash keys are sorted into files of the shared folder, split by their high bits, beside the rules
themselves. Tasks map the files into memory, probe whole batches by binary search, and confirm hits letter by letter.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stage

#: Rules in a file on average.
SHARD = 4_000_000


def _local(folder: str) -> str | None:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None if "://" in folder else folder


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole: to another name first, so that a task that is lost or runs twice leaves no part of one."""
    temporary = f"{name}.{uuid.uuid4().hex}"
    if at := _local(folder):
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/{temporary}", "wb") as f:
            f.write(data)
        os.replace(f"{at}/{temporary}", f"{at}/{name}")
        return
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{temporary}") as f:
        f.write(data)
    files.move(f"{root}/{temporary}", f"{root}/{name}")


def _map(folder: str, name: str, kind: type) -> np.ndarray:
    """The file as an array, mapped into memory where the folder is mounted; empty if there is none."""
    if at := _local(folder):
        path = f"{at}/{name}"
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return np.empty(0, kind)
    with files.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


class DigestArray:
    """Rules in files of a shared folder: sorted keys, and where each rule's letters are."""

    def __init__(self, folder: str, bits: int) -> None:
        self.folder, self.bits = folder, bits

    @classmethod
    def build(cls, rules: DataFrame, column: str) -> DigestArray:
        """From a column of strings; nulls and repetitions don't count."""
        spark = rules.sparkSession
        unique = stage(rules.where(F.col(column).isNotNull()).select(F.col(column).alias("rule")).distinct().withColumn("key", F.xxhash64("rule")), "rules")
        bits = max(0, (-(-unique.count() // SHARD) - 1).bit_length())
        folder = shared_path(spark, "digests")

        def write(t: pa.Table) -> pa.Table:
            keys = t["key"].to_numpy().astype(np.uint64)
            order = np.argsort(keys, kind="stable")
            letters = [r.encode() for r in t["rule"].take(pa.array(order)).to_pylist()]
            shard = t["shard"][0].as_py()
            _put(folder, f"{shard}.letters", b"".join(letters))
            _put(folder, f"{shard}.ends", np.cumsum([len(x) for x in letters], dtype=np.int64).tobytes())
            _put(folder, f"{shard}.keys", keys[order].tobytes())
            return pa.table({"shard": [shard], "n": [len(letters)]})

        shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
        unique.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard long, n long").agg(F.sum("n")).collect()
        return cls(folder, bits)

    def find(self, keys: np.ndarray, strings: list[str]) -> np.ndarray:
        """Which strings are rules; ``keys`` are their uint64 digests."""
        out = np.zeros(len(keys), bool)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(shard):
            sorted_keys, ends, letters = _files(self.folder, int(s))
            if not len(sorted_keys):
                continue
            rows = np.flatnonzero(shard == s)
            at = np.searchsorted(sorted_keys, keys[rows])
            hit = sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys[rows]
            for r, p in zip(rows[hit], at[hit]):
                want = strings[r].encode()
                while p < len(sorted_keys) and sorted_keys[p] == keys[r]:  # rules that collide stand next to each other
                    if letters[(ends[p - 1] if p else 0) : ends[p]].tobytes() == want:
                        out[r] = True
                        break
                    p += 1
        return out


@lru_cache(maxsize=256)
def _files(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _map(folder, f"{shard}.keys", np.uint64), _map(folder, f"{shard}.ends", np.int64), _map(folder, f"{shard}.letters", np.uint8)


def canonical(url: Column) -> Column:
    """Host in lower case, path and query; without scheme, user, port, fragment and a slash at the end."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^[\s\S]*@", ""), r":[0-9]*$", ""))
    return F.regexp_replace(F.concat(host, F.regexp_replace(rest, r"^[^/?]*", "")), r"/$", "")


def keys_of(url: Column) -> Column:
    """What rules may name: the canonical URL, the same without its query, the host, and the domains above it that have a dot."""
    whole = canonical(url)
    labels = F.split(F.regexp_extract(whole, r"^[^/?]*", 0), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.concat_ws(".", F.slice(labels, i + 1, n)))
    return F.array_distinct(F.concat(F.array(whole, F.regexp_replace(whole, r"/?\?[\s\S]*$", "")), domains))


def match(pages: DataFrame, rules: DataFrame, rule_col: str = "rule", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, blocked, rule) for every row of ``pages``; only its id and URL are read.

    A rule is a canonical URL, one without query, or a domain, which also blocks the hosts below it. ``rule`` is the
    first that holds, from the whole URL to the shortest domain. A null or empty URL is not blocked. Null ids stay; repeated rows
    are judged alike; with no rules nothing is blocked; an empty table gives no rows.
    """
    digests = DigestArray.build(rules, rule_col)

    @F.pandas_udf("string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, keys in batches:
            counts = np.array([0 if x is None else len(x) for x in names])
            flat = [s for x in names if x is not None for s in x]
            hashes = np.array([h for x in keys if x is not None for h in x], np.int64).astype(np.uint64)
            found = digests.find(hashes, flat)
            ends = np.cumsum(counts)
            out: list[str | None] = [None] * len(counts)
            for p in np.flatnonzero(found)[::-1]:
                out[int(np.searchsorted(ends, p, "right"))] = flat[p]
            yield pd.Series(out, dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    keyed = rows.withColumn("names", F.when(F.col("url") != "", keys_of(F.col("url")))).withColumn("keys", F.transform("names", lambda s: F.xxhash64(s)))
    judged = keyed.select("page_id", "url", probe("names", "keys").alias("rule"))
    return judged.select("page_id", "url", F.col("rule").isNotNull().alias("blocked"), "rule")
