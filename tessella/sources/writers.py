"""Writers of the tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, compression: str = "zstd") -> None:
    """Every table as a Parquet folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")


def write_gmt(sets: DataFrame, path: str) -> None:
    """(set_name, genes) as lines: name, empty description, genes."""
    sets.select(F.concat_ws("\t", F.col("set_name"), F.lit(""), F.concat_ws("\t", "genes"))).write.mode("overwrite").text(path)


def dense_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A column a gene, a row a cell, zeros filled in; for as many genes as a table may have columns."""
    names = [r["gene_name"] for r in tables["genes"].orderBy("gene_id").collect()]
    named = tables["expr"].join(F.broadcast(tables["genes"]), "gene_id").join(tables["cells"].select("cell_id", "cell_name"), "cell_id")
    wide = named.groupBy("cell_name").pivot("gene_name", names).agg(F.sum("value"))
    return tables["cells"].select("cell_name").join(wide, "cell_name", "left").fillna(0.0, names)


def write_spatial_csv(tables: dict[str, DataFrame], path: str, prefix: str = "spatial") -> None:
    """Dense counts, coordinates and all other columns of the cells as three CSV folders."""
    cells = tables["cells"]
    dense_counts(tables).write.mode("overwrite").csv(f"{path}/{prefix}_counts", header=True)
    cells.select("cell_name", "x", "y").write.mode("overwrite").csv(f"{path}/{prefix}_coordinates", header=True)
    cells.select("cell_name", *[c for c in cells.columns if c not in {"cell_name", "x", "y"}]).write.mode("overwrite").csv(f"{path}/{prefix}_metadata", header=True)


def export_spatial(tables: dict[str, DataFrame], path: str, pixels: DataFrame | None = None) -> None:
    """Points with their geometry as a struct and as WKT, the counts, and the mask if there is one."""
    cells = tables["cells"]
    points = cells.withColumn("geometry", F.struct("x", "y")).withColumn("wkt", F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))
    write_tables({"points": points, "table": tables["expr"], "genes": tables["genes"]} | ({"labels": pixels} if pixels is not None else {}), path)


__all__ = ["write_tables", "write_gmt", "dense_counts", "write_spatial_csv", "export_spatial"]
