"""Synthetic cells, counts and images. A seed decides every value, whatever the partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import uniform


def _negative_binomial(u: Column, most: int = 40) -> Column:
    """Quantile of NB(2, 0.5) at u: the number of terms (k + 1) / 2^(k + 2) that fit under it."""
    terms, total = [], 0.0
    for k in range(most):
        total += (k + 1) / 2 ** (k + 2)
        terms.append(total)
    return F.size(F.filter(F.lit(terms), lambda t: t < u)).cast("double")


def synthetic_data(spark: SparkSession, n_cells: int = 10_000, n_genes: int = 500, n_clusters: int = 10, extent: tuple[float, float] = (0, 1000), sparsity: float = 0.9, seed: int = 0) -> dict[str, DataFrame]:
    """Uniform places and clusters, NB(2, 0.5) counts of which a share ``sparsity`` is left out."""
    low, high = extent
    cells = spark.range(n_cells).select(
        F.col("id").alias("cell_id"), F.concat(F.lit("cell_"), "id").alias("cell_name"), (uniform(F.lit(f"{seed}x"), "id") * (high - low) + low).alias("x"), (uniform(F.lit(f"{seed}y"), "id") * (high - low) + low).alias("y"),
        F.concat(F.lit("cluster_"), F.floor(uniform(F.lit(f"{seed}c"), "id") * n_clusters).cast("string")).alias("cluster"),
    )
    genes = spark.range(n_genes).select(F.col("id").alias("gene_id"), F.concat(F.lit("gene_"), "id").alias("gene_name"))
    grid = cells.select("cell_id").withColumn("gene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_genes - 1).cast("long"))))
    live = grid.where(uniform(F.lit(f"{seed}m"), "cell_id", "gene_id") >= sparsity)
    expr = live.select("cell_id", "gene_id", _negative_binomial(uniform(F.lit(f"{seed}v"), "cell_id", "gene_id")).alias("value")).where("value > 0")
    return {"cells": cells, "genes": genes, "expr": expr}


def spatial_clusters(spark: SparkSession, n_cells_per_cluster: int = 1000, n_clusters: int = 10, n_genes: int = 500, cluster_radius: float = 50.0, extent: tuple[float, float] = (0, 1000), noise: float = 0.1, seed: int = 0) -> dict[str, DataFrame]:
    """Discs of cells with Gaussian noise, clipped to the extent; every cluster raises its own block of genes."""
    low, high = extent
    u = lambda tag, *key: uniform(F.lit(f"{seed}{tag}"), *key)
    base = spark.range(n_cells_per_cluster * n_clusters).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / n_cells_per_cluster).cast("int").alias("c"))
    gauss = lambda a, b: F.sqrt(-2 * F.log(F.greatest(u(a, "cell_id"), F.lit(1e-12)))) * F.cos(2 * math.pi * u(b, "cell_id"))
    r, angle = u("r", "cell_id") * cluster_radius, u("a", "cell_id") * (2 * math.pi)
    place = lambda tag, f, g: F.least(F.greatest(u(tag, "c") * (high - low) + low + r * f(angle) + g * noise * cluster_radius, F.lit(float(low))), F.lit(float(high)))
    cells = base.select("cell_id", F.concat(F.lit("cell_"), "cell_id").alias("cell_name"), place("X", F.cos, gauss("g", "h")).alias("x"), place("Y", F.sin, gauss("i", "j")).alias("y"), F.concat(F.lit("cluster_"), "c").alias("cluster"), "c")
    genes = spark.range(n_genes).select(F.col("id").alias("gene_id"), F.concat(F.lit("gene_"), "id").alias("gene_name"))
    block = max(1, n_genes // n_clusters)
    grid = cells.select("cell_id", "c").withColumn("gene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_genes - 1).cast("long"))))
    value = _negative_binomial(u("v", "cell_id", "gene_id")) + F.when(F.floor(F.col("gene_id") / block) == F.col("c"), 5.0).otherwise(0.0)
    expr = grid.where(u("m", "cell_id", "gene_id") >= 0.7).select("cell_id", "gene_id", value.alias("value")).where("value > 0")
    return {"cells": cells.drop("c"), "genes": genes, "expr": expr}


def cells_image(spark: SparkSession, n_cells: int = 100, size: tuple[int, int] = (512, 512), radii: tuple[int, int] = (10, 30), noise: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pixels, image): discs that don't overlap, placed one after another, brighter in the middle."""
    rng = np.random.default_rng(seed)
    mask, image = np.zeros(size, np.int32), np.zeros(size)
    yy, xx = np.mgrid[: size[0], : size[1]]
    placed, tries = [], 0
    while len(placed) < n_cells and tries < 100 * n_cells:
        tries += 1
        r = int(rng.integers(radii[0], radii[1] + 1))
        if 2 * r >= min(size):
            continue
        y, x = rng.integers(r, size[0] - r), rng.integers(r, size[1] - r)
        if all((y - a) ** 2 + (x - b) ** 2 >= (r + c) ** 2 for a, b, c in placed):
            placed.append((y, x, r))
            d = np.sqrt((yy - y) ** 2 + (xx - x) ** 2)
            mask[d <= r] = len(placed)
            image[d <= r] = (1 - 0.5 * d[d <= r] / r) * rng.uniform(0.3, 1.0)
    image = np.clip(image + rng.normal(0, noise, size), 0, 1)
    r, c = np.nonzero(mask)
    pixels = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), mask[r, c].tolist())), "row int, col int, label int")
    rows, cols = (a.ravel().tolist() for a in (yy, xx))
    return pixels, spark.createDataFrame(list(zip(rows, cols, image.ravel().tolist())), "row int, col int, value double")


__all__ = ["synthetic_data", "spatial_clusters", "cells_image"]
