"""Tables of the data model and helpers that every operator uses."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "cell_id long, cell_name string, x double, y double"
EXPR = "cell_id long, gene_id long, value double"
EDGES = "src long, dst long, weight double, distance double"
PIXELS = "row int, col int, label int"
TRANSCRIPTS = "x double, y double, gene string"
FRACTIONS = "cell_id long, cell_type string, fraction double"
REF_PROFILES = "gene string, cell_type string, value double"
LR_PAIRS = "ligand string, receptor string"
SURVIVAL = "sample string, time double, event int"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if it has the columns; else a ``KeyError`` that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def null_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in float columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, and ``other`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(other))


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that the key decides, the same in every engine that has md5."""
    text = F.concat_ws("_", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*key: Column | str) -> Column:
    return F.md5(F.concat_ws("_", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); where none is set, a temporary one for a session in one process, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_index(df: DataFrame, key: str = "cell_id", *keep: str) -> DataFrame:
    """(key, keep..., idx): the keys of ``df`` numbered from 0 in their order, by ranges: no task sorts all of them."""
    parts = df.select(key, *keep).repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id())
    parts = cut(parts)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row for each partition
    return parts.join(F.broadcast(first), "part").select(key, *keep, (F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + F.col("first")).alias("idx"))


_PRIME = 2_147_483_647


def permuted(idx: np.ndarray, n: int, seed: int, draw: int) -> np.ndarray:
    """A bijection of [0, n) that seed and draw decide: four Feistel rounds on the bits, repeated where they lead past n.

    Each place is computed on its own, so a permutation needs neither a sort nor the other places.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def rounds(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for r in range(4):
            x = (right + (seed * 7_919 + draw * 104_729 + r * 15_485_863 + 12_345)) % _PRIME
            left, right = right, left ^ (((x * x) % _PRIME * 48_271) % _PRIME & mask)
        return (left << half) | right

    out = rounds(np.asarray(idx, np.int64))
    while (past := out >= n).any():
        out[past] = rounds(out[past])
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as shuffles have: few bytes that are much work are else put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ["cell_id"]))


def coordinates(df: DataFrame) -> DataFrame:
    """``df`` with x and y (and z) from the first pair of columns that it has."""
    for x, y, z in (("x", "y", "z"), ("x_um", "y_um", "z_um"), ("coordinate_x_um", "coordinate_y_um", ""), ("x_centroid", "y_centroid", "z_centroid"), ("array_col", "array_row", "")):
        if x in df.columns and y in df.columns:
            new = {"x": F.col(x).cast("double"), "y": F.col(y).cast("double")}
            return df.withColumns(new | ({"z": F.col(z).cast("double")} if z in df.columns else {}))
    raise KeyError(f"no coordinates among {', '.join(df.columns)}")


def chunked(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int | None = None) -> DataFrame:
    """``f`` on every batch of rows, of at most ``rows`` each, where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), rows or max(1, len(b))):
                yield f(b.iloc[lo : lo + (rows or len(b))])

    return df.mapInPandas(run, schema)
