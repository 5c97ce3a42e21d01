"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^ \t\n\r\f]+"
#: Rows of a key table up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where none is set, a session in one process gets a temporary one; on a cluster that is an error, as executors of
    other machines could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def word_count(text: Column) -> Column:
    """Words between white space, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if it has at most ``limit`` rows. It should be a staged table, as it is counted."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def draw(df: DataFrame, total: int, n: int, *key: str) -> DataFrame:
    """At most ``n`` of the ``total`` rows, those of the least hash of their key.

    A threshold on the hash leaves about ``n`` rows before they are ordered, so that partitions don't each send ``n``.
    """
    share = min(1.0, 1.1 * (n + 100) / max(total, 1))
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    return df.where(h < int(share * (1 << 40)) + 1).orderBy(h, *key).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
