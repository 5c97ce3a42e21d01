"""Readers of platform files. Counts come as (cell_id, gene_id, value) without zeros; ids are positions from 0."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import cut, dense_index, null_nan, small
from ..operators.spatial import micrometres

Tables = dict[str, DataFrame]
_POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row double, pxl_col double"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, block, k) of the lines of one text file; (block, k) is in their order: where the split begins, and a count within it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, value): lines of one text file with their place from 0; lines are counted by split, so that no task has all of them."""
    lines = cut(_placed(spark, path))
    sizes = lines.groupBy("block").agg(F.count("*").alias("n"))
    first = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("first"))  # a row for each split
    place = F.row_number().over(Window.partitionBy("block").orderBy("k")) - 1 + F.col("first")
    return lines.join(F.broadcast(first), "block").select(place.alias(name), "value")


def _wide(spark: SparkSession, path: str) -> DataFrame:
    if str(path).endswith(".parquet"):
        return spark.read.parquet(str(path))
    return spark.read.csv(str(path), header=True, inferSchema=False)


def _first(folder: Path, *patterns: str) -> str:
    for p in patterns:
        found = sorted(folder.glob(p))
        if found:
            return str(found[0])
    raise FileNotFoundError(f"none of {', '.join(patterns)} in {folder}")


def melt(wide: DataFrame, id_col: str, skip: tuple[str, ...] = ()) -> Tables:
    """Cells, genes and nonzero counts of a table with one column a gene."""
    names = [c for c in wide.columns if c != id_col and c not in skip]
    cells = wide.select(F.col(id_col).cast("string").alias("cell_name")).distinct()
    cells = cut(dense_index(cells, "cell_name").withColumnRenamed("idx", "cell_id"))
    genes = wide.sparkSession.createDataFrame(list(enumerate(names)), "gene_id long, gene_name string")
    long = wide.select(F.col(id_col).cast("string").alias("cell_name"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(["cell_name"], names, "gene_name", "value")
    expr = long.where("value <> 0").join(F.broadcast(genes), "gene_name").join(cells, "cell_name").select("cell_id", "gene_id", "value")
    return {"cells": cells, "genes": genes, "expr": expr}


def _located(tables: Tables, where: DataFrame, how: str = "left") -> Tables:
    return tables | {"cells": tables["cells"].join(where, "cell_name", how)}


def read_mtx(spark: SparkSession, folder: str) -> Tables:
    """MatrixMarket triples with features and barcodes, gzipped or not; a gene's name is its second field."""
    root = Path(folder)
    triples = _placed(spark, _first(root, "matrix.mtx*")).where(~F.col("value").startswith("%"))
    # the first line that is no remark holds the size
    head = triples.agg(F.min(F.struct("block", "k")).alias("m")).select("m.block", "m.k").first()
    part = F.split("value", r"\s+")
    entry = (F.size(part) == 3) & ((F.col("block") != head["block"]) | (F.col("k") != head["k"]))
    rows = triples.where(entry).select(part[0].cast("long").alias("i"), part[1].cast("long").alias("j"), part[2].cast("double").alias("value"))
    features = _numbered(spark, _first(root, "features.tsv*", "genes.tsv*"), "gene_id")
    fields = F.split("value", "\t")
    genes = features.select("gene_id", F.coalesce(F.try_element_at(fields, F.lit(2)), fields[0]).alias("gene_name"))
    cells = _numbered(spark, _first(root, "barcodes.tsv*"), "cell_id").select("cell_id", F.col("value").alias("cell_name"))
    expr = rows.where("value <> 0").select((F.col("j") - 1).alias("cell_id"), (F.col("i") - 1).alias("gene_id"), "value")
    return {"cells": cells, "genes": genes, "expr": expr}


def read_tissue_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The first of the list without header, the CSV with header, and the Parquet file."""
    root = Path(folder)
    if (root / "tissue_positions_list.csv").exists():
        return spark.read.schema(_POSITIONS).csv(str(root / "tissue_positions_list.csv"))
    if (root / "tissue_positions.csv").exists():
        return spark.read.schema(_POSITIONS).csv(str(root / "tissue_positions.csv"), header=True)
    p = spark.read.parquet(_first(root, "tissue_positions.parquet"))
    return p.select("barcode", F.col("in_tissue").cast("int").alias("in_tissue"), F.col("array_row").cast("int").alias("array_row"), F.col("array_col").cast("int").alias("array_col"), F.col("pxl_row_in_fullres").cast("double").alias("pxl_row"), F.col("pxl_col_in_fullres").cast("double").alias("pxl_col"))


def read_visium(spark: SparkSession, folder: str) -> Tables:
    """Spots in tissue of a Visium folder: names ``{row}x{column}``, pixels scaled to the low-resolution image, micrometres."""
    root = Path(folder)
    counts = read_mtx(spark, str(next(p for p in (root / "filtered_feature_bc_matrix", root) if (p.is_dir() and list(p.glob("matrix.mtx*"))))))
    factors = json.loads((root / "spatial" / "scalefactors_json.json").read_text())
    scale = float(factors.get("tissue_lowres_scalef", 1.0))
    at = read_tissue_positions(spark, str(root / "spatial")).where("in_tissue = 1")
    at = micrometres(at).withColumns({"x": F.round(F.col("pxl_col") * scale, 3), "y": F.round(F.col("pxl_row") * scale, 3)})
    cells = counts["cells"].withColumnRenamed("cell_name", "barcode").join(at, "barcode")
    cells = cells.withColumn("cell_name", F.concat_ws("x", "array_row", "array_col"))
    return counts | {"cells": cells, "expr": counts["expr"].join(cells.select("cell_id"), "cell_id", "left_semi")}


def read_xenium(spark: SparkSession, folder: str, counts: Tables | None = None) -> Tables:
    """Cells of a Xenium folder at their centroids, joined to the counts by name; an error if a counted cell has no place."""
    root = Path(folder)
    counts = counts or read_mtx(spark, str(root / "cell_feature_matrix"))
    where = _wide(spark, _first(root, "cells.parquet", "cells.csv*")).select(F.col("cell_id").cast("string").alias("cell_name"), F.col("x_centroid").cast("double").alias("x"), F.col("y_centroid").cast("double").alias("y"))
    if not counts["cells"].join(where, "cell_name", "left_anti").isEmpty():
        raise KeyError("a cell of the matrix is missing in the cells file")
    return _located(counts, where, "inner")


def read_cosmx(spark: SparkSession, folder: str, fov: int | list[int] | None = None) -> Tables:
    """Expression matrix and metadata of a CosMx folder; the filter by field of view reaches the scan. Global pixels are preferred."""
    root = Path(folder)
    wide = _wide(spark, _first(root, "*exprMat*.parquet", "*exprMat*.csv"))
    if fov is not None:
        wide = wide.where(F.col("fov").cast("int").isin(fov if isinstance(fov, list) else [fov]))
    wide = wide.withColumn("__cell", F.concat_ws("_", "fov", "cell_ID"))
    tables = melt(wide, "__cell", ("fov", "cell_ID"))
    meta = _wide(spark, _first(root, "*metadata*.parquet", "*metadata*.csv"))
    x, y = next((a, b) for a, b in (("CenterX_global_px", "CenterY_global_px"), ("CenterX_local_px", "CenterY_local_px")) if a in meta.columns)
    where = meta.select(F.concat_ws("_", "fov", "cell_ID").alias("cell_name"), F.col("fov").cast("int").alias("fov"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return _located(tables, where)


def read_merscope(spark: SparkSession, folder: str) -> Tables:
    """Counts by cell of a MERSCOPE folder with metadata where there is some."""
    root = Path(folder)
    wide = _wide(spark, _first(root, "cell_by_gene.csv", "cell_by_gene.parquet"))
    tables = melt(wide, wide.columns[0])
    try:
        meta = _wide(spark, _first(root, "cell_metadata.csv", "cell_metadata.parquet"))
    except FileNotFoundError:
        return tables
    x, y = next((a, b) for a, b in (("center_x", "center_y"), ("x", "y"), ("min_x", "min_y")) if a in meta.columns)
    return _located(tables, meta.select(F.col(meta.columns[0]).cast("string").alias("cell_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))


def read_spatial(spark: SparkSession, count_file: str, coord_file: str, x_col: str = "x", y_col: str = "y") -> Tables:
    """Cells by genes and coordinates as CSV or Parquet, the first column of either the cell's name; cells without a place keep null coordinates."""
    wide, where = _wide(spark, count_file), _wide(spark, coord_file)
    where = where.select(F.col(where.columns[0]).cast("string").alias("cell_name"), F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y"))
    tables = _located(melt(wide, wide.columns[0]), where)
    return tables | {"cells": null_nan(tables["cells"])}


read_spatial_csv = read_spatial_parquet = read_spatial


def create_spots(counts: DataFrame, coordinates: DataFrame) -> Tables:
    """Tables of wide counts (genes by spots, first column the gene) and coordinates; the names have to be the same set."""
    gene = counts.columns[0]
    spots = [c for c in counts.columns if c != gene]
    spark = counts.sparkSession
    named = coordinates.select(F.col(coordinates.columns[0]).cast("string").alias("cell_name"), *[F.col(c).cast("double").alias(a) for c, a in zip(_xy(coordinates), "xy")])
    cells = spark.createDataFrame(list(enumerate(spots)), "cell_id long, cell_name string")
    if not cells.select("cell_name").exceptAll(named.select("cell_name")).isEmpty() or not named.select("cell_name").exceptAll(cells.select("cell_name")).isEmpty():
        raise ValueError("counts and coordinates hold different spots")
    genes = cut(dense_index(counts.select(F.col(gene).alias("gene_name"), F.monotonically_increasing_id().alias("k")), "k", "gene_name").select("gene_name", F.col("idx").alias("gene_id")))
    long = counts.unpivot([gene], spots, "cell_name", "value").where("value <> 0")
    expr = long.join(genes, F.col(gene) == F.col("gene_name")).join(F.broadcast(cells), "cell_name").select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))
    return {"cells": cells.join(named, "cell_name"), "genes": genes.select("gene_id", "gene_name"), "expr": expr}


def _xy(df: DataFrame) -> list[str]:
    lower = {c.lower(): c for c in df.columns}
    return [lower["x"], lower["y"]] if {"x", "y"} <= set(lower) else df.columns[1:3]


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, genes) of lines with a name, a description and at least one gene; of equal names the last."""
    lines = _numbered(spark, str(path), "line")
    f = F.split(F.rtrim("value"), "\t")
    sets = lines.where(F.size(f) >= 3).select("line", f[0].alias("set_name"), F.filter(F.slice(f, 3, F.size(f)), lambda g: g != "").alias("genes"))
    return sets.groupBy("set_name").agg(F.max_by("genes", "line").alias("genes"))


def gene_sets(gmt: DataFrame, genes: DataFrame) -> DataFrame:
    """(set_name, gene_id) of the genes that are in the data."""
    return gmt.select("set_name", F.explode("genes").alias("gene_name")).join(small(genes), "gene_name").select("set_name", "gene_id").distinct()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cell_type, value) of a CSV with one column a cell type."""
    wide = spark.read.csv(str(path), header=True, inferSchema=True)
    gene, *types = wide.columns
    return wide.select(F.col(gene).alias("gene"), *[F.col(f"`{t}`").cast("double").alias(t) for t in types]).unpivot(["gene"], types, "cell_type", "value")


def read_lr_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ligand, receptor) of the second and fourth column of a table with tabs and a header."""
    t = spark.read.csv(str(path), sep="\t", header=True)
    return t.select(F.col(t.columns[1]).alias("ligand"), F.col(t.columns[3]).alias("receptor")).distinct()


def cancer_signature(dictionary: DataFrame, cancer: str) -> DataFrame:
    """(kind, gene, weight) of the first kind whose name holds the type: CNA, then expr; then PANCAN's expr; else one row of kind seq_depth.

    ``dictionary``: (kind, pos, name, gene, weight).
    """
    rank = (
        F.when((F.col("kind") == "CNA") & F.col("name").contains(cancer), 1)
        .when((F.col("kind") == "expr") & F.col("name").contains(cancer), 2)
        .when((F.col("kind") == "expr") & F.col("name").contains("PANCAN"), 3)
    )
    ranked = dictionary.withColumn("rank", rank).where("rank is not null")
    best = ranked.orderBy("rank", "pos").limit(1).select("kind", "name")
    found = dictionary.join(F.broadcast(best), ["kind", "name"], "left_semi").select("kind", "gene", "weight")
    none = dictionary.sparkSession.createDataFrame([("seq_depth", None, None)], "kind string, gene string, weight double")
    return found if not best.isEmpty() else none


__all__ = [n for n in dict(globals()) if n.startswith(("read_", "gene_sets", "melt", "create_", "cancer_"))]
