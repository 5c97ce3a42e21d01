"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every sender (a file of the scan) sorts the fingerprints of its texts, splits them by owner (their high bits) and
sends each owner one Golomb-coded list. Owners answer with a bitmap of the fingerprints that occur more than once.
Only rows whose bit is set, the suspects, are shuffled with their text, and their bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, shared_path, stage

BITS = 48
#: Fingerprints that an owner gets, about; there are as many owners as that takes, and one for each shuffle partition at least.
OWNED = 2_000_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences in Golomb code with a power of two as divisor: unary quotients, then remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, k, len(unary)], np.uint32).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    body = np.frombuffer(blob, np.uint8, offset=12)
    cut = (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=bits) == 0)
    q = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(body[cut:], count=n * k).reshape(n, k).astype(np.uint64)
    low = (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)


def _send(owner_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        senders, prints = [], []
        for b in batches:
            senders.append(b.column(0).to_numpy(zero_copy_only=False))
            prints.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64))
        if not senders:
            return
        sender, fp = np.concatenate(senders), np.concatenate(prints)
        order = np.lexsort((fp, sender))
        sender, fp = sender[order], fp[order]
        owner = (fp >> np.uint64(BITS - owner_bits)).astype(np.int64)
        cuts = np.flatnonzero((np.diff(sender) != 0) | (np.diff(owner) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
        for lo in range(0, len(starts), 10_000):
            part = [(s, e) for s, e in zip(starts[lo : lo + 10_000], ends[lo : lo + 10_000]) if e > s]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(sender[s]) for s, _ in part], pa.int64()),
                    pa.array([int(owner[s]) for s, _ in part], pa.int64()),
                    pa.array([golomb_encode(fp[s:e]) for s, e in part], pa.binary()),
                ],
                names=["sender", "owner", "blob"],
            )

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(b) for b in pdf["blob"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    maps = [np.isin(x, twice) for x in lists]
    some = [i for i, m in enumerate(maps) if m.any()]
    return pd.DataFrame(
        {"sender": pdf["sender"].iloc[some].to_numpy(), "blob": [pdf["blob"].iloc[i] for i in some], "bitmap": [np.packbits(maps[i]).tobytes() for i in some]}
    )


def _load(folder: str, sender: int) -> np.ndarray:
    """The fingerprints of a sender whose bits the owners have set."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    at = f"{root}/sender={sender}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return np.empty(0, np.uint64)
    got = ds.dataset(at, format="parquet", filesystem=files).to_table(["blob", "bitmap"])
    out = []
    for blob, bitmap in zip(got["blob"].to_pylist(), got["bitmap"].to_pylist()):
        x = golomb_decode(blob)
        out.append(x[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(x)).astype(bool)])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _with_suspects(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called c0, c1, ..., and two more: the fingerprint ``fp`` and ``suspect``, whether that occurs twice.

    The names that columns had play no part, so that none can clash; callers give them back.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    if "_metadata" in (c.lower() for c in docs.columns):
        plain = stage(docs.toDF(*names), "rows")
    else:
        plain = docs.toDF(*names)
        try:
            plain.select("_metadata.file_path").schema  # noqa: B018
        except AnalysisException:  # not the rows of files: then they are written to some
            plain = stage(plain, "rows")
    text_c = names[docs.columns.index(text)]
    fp = F.xxhash64(F.col(text_c)).bitwiseAND(F.lit((1 << BITS) - 1))
    keyed = plain.withColumn("sender", F.xxhash64(F.col("_metadata.file_path"))).withColumn("fp", F.when(F.col(text_c).isNotNull(), fp))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plain.count() // OWNED))
    owner_bits = max(1, (owners - 1).bit_length())
    sent = keyed.where(F.col("fp").isNotNull()).select("sender", "fp").mapInArrow(_send(owner_bits), "sender long, owner long, blob binary")
    folder = shared_path(spark, "answers")
    replies = sent.repartition(owners, "owner").groupBy("owner").applyInPandas(_answer, "sender long, blob binary, bitmap binary")
    replies.repartition("sender").write.partitionBy("sender").parquet(folder)

    @F.pandas_udf("boolean")
    def suspect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[int, np.ndarray] = {}
        for sender, prints in batches:
            out = np.zeros(len(sender), bool)
            ids, fps = sender.to_numpy(), prints.fillna(-1).to_numpy().astype(np.int64)
            for s in np.unique(ids):
                if s not in known:
                    known[s] = _load(folder, s)
                at = ids == s
                out[at] = np.isin(fps[at].astype(np.uint64), known[s]) & (fps[at] >= 0)
            yield pd.Series(out)

    return keyed.withColumn("suspect", suspect(F.col("sender"), F.col("fp"))).drop("sender"), names


def duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) for every row but the first of those with byte-equal texts; the first has the least id, nulls last.

    A null text equals no other and is in no pair; empty texts equal each other. A repeated row is a duplicate of its
    first copy, so that both ids are the same. Other columns play no part. An empty table gives no pairs.
    """
    marked, _ = _with_suspects(docs.select(col(id_col).alias("doc_id"), col(text).alias("text")), "text")
    same = Window.partitionBy("fp", "c1").orderBy(F.col("c0").asc_nulls_last())
    ranked = marked.where("suspect").withColumn("rn", F.row_number().over(same)).withColumn("duplicate_of", F.first("c0").over(same))
    return ranked.where("rn > 1").select(F.col("c0").alias("doc_id"), "duplicate_of")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first row of each set of byte-equal texts: that of the least id (nulls last).

    Rows with a null text all stay. Columns and their order stay, whatever their names; an empty table stays empty.
    """
    marked, names = _with_suspects(docs, text)
    at = dict(zip(docs.columns, names))
    first = Window.partitionBy("fp", at[text]).orderBy(F.col(at[id_col]).asc_nulls_last())
    kept = marked.where("suspect").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return marked.where("not suspect").select(names).unionAll(kept.select(names)).toDF(*docs.columns)
