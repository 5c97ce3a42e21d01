"""Label masks as pixels (row, col, label), background left out, and the transcripts that fall on them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ratio
from .graph import connected_components

_FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
_EIGHT = (*_FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def segments(pixels: DataFrame) -> DataFrame:
    """(label, area, centroid_row, centroid_col) of labels above 0."""
    return pixels.where("label > 0").groupBy("label").agg(F.count("*").alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"))


def boundaries(pixels: DataFrame, connectivity: int = 1) -> DataFrame:
    """Pixels with a neighbour (4 or, for connectivity 2, 8) that is of another label or none; the image's edge counts as none."""
    p = pixels.where("label > 0")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in (_FOUR if connectivity == 1 else _EIGHT)])
    near = p.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "label")
    # a pixel is inside if all its neighbours send it its own label
    votes = near.groupBy("row", "col", "label").agg(F.count("*").alias("votes"))
    inside = votes.where(F.col("votes") == (4 if connectivity == 1 else 8)).select("row", "col", "label")
    return p.select("row", "col", "label").join(inside, ["row", "col", "label"], "left_anti")


def circularity(pixels: DataFrame) -> DataFrame:
    """(label, circularity): 4 pi area over the square of the boundary's pixels; 1 where there is no boundary."""
    edge = boundaries(pixels).groupBy("label").agg(F.count("*").alias("edge"))
    s = segments(pixels).join(edge, "label", "left")
    return s.select("label", F.when(F.coalesce("edge", F.lit(0)) == 0, 1.0).otherwise(ratio(F.col("area") * (4 * math.pi), F.col("edge") * F.col("edge"))).alias("circularity"))


def relabel(pixels: DataFrame) -> DataFrame:
    """Labels 1..k in the order of the old ones."""
    old = pixels.select("label").distinct().withColumn("new", F.row_number().over(Window.orderBy("label")))
    return pixels.join(old, "label").select("row", "col", F.col("new").alias("label"))


def filter_by_size(pixels: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Pixels of labels whose area is within the bounds, relabelled."""
    area = segments(pixels).where(F.col("area") >= least)
    if most is not None:
        area = area.where(F.col("area") <= most)
    return relabel(pixels.where("label > 0").join(area.select("label"), "label", "left_semi"))


def remove_edge_cells(pixels: DataFrame, height: int, width: int, buffer: int = 0) -> DataFrame:
    """Pixels of labels that don't touch the first or last ``buffer`` + 1 rows and columns; labels stay."""
    edge = (F.col("row") <= buffer) | (F.col("row") >= height - 1 - buffer) | (F.col("col") <= buffer) | (F.col("col") >= width - 1 - buffer)
    p = pixels.where("label > 0")
    return p.join(p.where(edge).select("label").distinct(), "label", "left_anti").select("row", "col", "label")


def expand(pixels: DataFrame, height: int, width: int, distance: int = 5) -> DataFrame:
    """Every pixel within the distance of a label, given to the lowest such label, even over another cell's own pixels."""
    steps = [(r, c) for r in range(-distance, distance + 1) for c in range(-distance, distance + 1) if r * r + c * c <= distance * distance]
    s = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    wide = pixels.where("label > 0").withColumn("s", s).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "label")
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return wide.where(inside).groupBy("row", "col").agg(F.min("label").alias("label"))


def iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(predicted, truth, intersection, iou) of labels that share pixels."""
    p, t = predicted.where("label > 0").withColumnRenamed("label", "predicted"), truth.where("label > 0").withColumnRenamed("label", "truth")
    both = p.join(t, ["row", "col"]).groupBy("predicted", "truth").agg(F.count("*").alias("intersection"))
    areas = both.join(p.groupBy("predicted").agg(F.count("*").alias("a")), "predicted").join(t.groupBy("truth").agg(F.count("*").alias("b")), "truth")
    return areas.select("predicted", "truth", "intersection", (F.col("intersection") / (F.col("a") + F.col("b") - F.col("intersection"))).alias("iou"))


def matches(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(predicted, truth, iou): one to one, greedily by the largest IoU at or above the threshold, then by the labels.

    Above a half no label can be in two such pairs, so a filter will do; below, the pairs of one image are matched
    on one task.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    pairs = iou(predicted, truth).where(F.col("iou") >= threshold).select("predicted", "truth", "iou")
    if threshold > 0.5:
        return pairs

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_p, used_t, keep = set(), set(), []
        for i, p, t in pdf.sort_values(["iou", "predicted", "truth"], ascending=[False, True, True])[["predicted", "truth"]].itertuples():
            if p not in used_p and t not in used_t:
                used_p.add(p), used_t.add(t), keep.append(i)
        return pdf.loc[keep]

    return pairs.groupBy(F.lit("all")).applyInPandas(greedy, "predicted int, truth int, iou double")


def segmentation_metrics(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, mean_iou, foreground_iou); nothing predicted and nothing there is perfect."""
    m = matches(predicted, truth, threshold).agg(F.count("*").alias("tp"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    p = predicted.where("label > 0").agg(F.count_distinct("label").alias("np"), F.count("*").alias("ap"))
    t = truth.where("label > 0").agg(F.count_distinct("label").alias("nt"), F.count("*").alias("at"))
    both = predicted.where("label > 0").select("row", "col").join(truth.where("label > 0").select("row", "col"), ["row", "col"]).agg(F.count("*").alias("both"))
    x = m.crossJoin(p).crossJoin(t).crossJoin(both)
    empty = (F.col("np") == 0) & (F.col("nt") == 0)
    precision, recall = ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("nt"))
    out = x.select(
        "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"),
        F.when(empty, 1.0).otherwise(precision).alias("precision"), F.when(empty, 1.0).otherwise(recall).alias("recall"),
        F.when(empty, 1.0).otherwise(F.col("mean_iou")).alias("mean_iou"),
        F.when(empty, 1.0).otherwise(ratio(F.col("both"), F.col("ap") + F.col("at") - F.col("both"))).alias("foreground_iou"),
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def quality_metrics(pixels: DataFrame, height: int, width: int, image: DataFrame | None = None) -> DataFrame:
    """(n, mean_area, std_area, min_area, max_area, mean_circularity, coverage[, mean_intensity, std_intensity]); deviations are the population's."""
    s = segments(pixels).join(circularity(pixels), "label")
    out = s.agg(
        F.count("*").alias("n"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.min("area").alias("min_area"), F.max("area").alias("max_area"),
        F.avg("circularity").alias("mean_circularity"), (F.coalesce(F.sum("area"), F.lit(0)) / F.lit(float(height * width))).alias("coverage"),
    )
    if image is None:
        return out
    per = pixels.where("label > 0").join(image, ["row", "col"]).groupBy("label").agg(F.avg("value").alias("v"))
    return out.crossJoin(per.agg(F.avg("v").alias("mean_intensity"), F.stddev_pop("v").alias("std_intensity")))


def assign(transcripts: DataFrame, pixels: DataFrame, height: int, width: int, pixel_size: float = 1.0) -> DataFrame:
    """Transcripts with row, col and label: the pixel by truncation, clipped into the image, so that what lies outside goes to its edge; 0 for none."""
    cell = lambda c, n: F.least(F.greatest((F.col(c) / pixel_size).cast("int"), F.lit(0)), F.lit(n - 1))
    at = transcripts.withColumns({"row": cell("y", height), "col": cell("x", width)})
    return at.join(pixels.where("label > 0").select("row", "col", "label"), ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def transcript_counts(assigned: DataFrame, pixels: DataFrame, least: int = 10) -> DataFrame:
    """(label, gene, n, area, centroid_row, centroid_col): counts in cells that have at least ``least`` transcripts."""
    n = assigned.where("label > 0").groupBy("label", "gene").agg(F.count("*").alias("n"))
    kept = n.withColumn("total", F.sum("n").over(Window.partitionBy("label"))).where(F.col("total") >= least).drop("total")
    return kept.join(segments(pixels), "label")


def transcript_density(assigned: DataFrame, pixels: DataFrame) -> DataFrame:
    """(label, density): transcripts over max(area, 1), 0 for cells without any."""
    n = assigned.where("label > 0").groupBy("label").agg(F.count("*").alias("n"))
    return segments(pixels).join(n, "label", "left").select("label", (F.coalesce("n", F.lit(0)) / F.greatest("area", F.lit(1))).alias("density"))


def combine(masks: list[DataFrame], how: str = "union") -> DataFrame:
    """(row, col, label): the foreground of any mask, all, or most of them, with its 4-connected parts as labels 1..k in order of their first pixel."""
    need = {"union": 1, "intersection": len(masks), "vote": len(masks) // 2 + 1}[how]
    every = masks[0].where("label > 0").select("row", "col")
    for m in masks[1:]:
        every = every.unionAll(m.where("label > 0").select("row", "col"))
    return components(every.groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("row", "col"))


def components(foreground: DataFrame) -> DataFrame:
    """4-connected parts of (row, col) as labels 1..k in order of their first pixel."""
    key = F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")
    p = foreground.select("row", "col", key.alias("cell_id"))
    steps = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c"))))
    near = p.withColumn("s", steps).select(F.col("cell_id").alias("src"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    edges = near.join(p.select("row", "col", F.col("cell_id").alias("dst")), ["row", "col"]).select("src", "dst")
    labelled = p.join(connected_components(p.select("cell_id"), edges), "cell_id")
    return relabel(labelled.select("row", "col", F.col("component").alias("label")))


def merge_tiles(tiles: list[tuple[int, int, np.ndarray]], shape: tuple[int, int], least: float = 0.5) -> np.ndarray:
    """One mask of tiles (top, left, labels) in order: a label joins the first cell that covers at least ``least`` of it, else it is new; later tiles overwrite."""
    out, last = np.zeros(shape, np.int32), 0
    for top, left, tile in tiles:
        h, w = min(tile.shape[0], shape[0] - top), min(tile.shape[1], shape[1] - left)
        view, part = out[top : top + h, left : left + w], tile[:h, :w]
        under = view.copy()
        for label in np.unique(part[part > 0]):
            at = part == label
            ids, n = np.unique(under[at & (under > 0)], return_counts=True)
            enough = ids[n / at.sum() >= least]
            if len(enough):
                view[at] = enough[0]
            else:
                last += 1
                view[at] = last
    return out


def tile_grid(height: int, width: int, tile: int, overlap: int) -> list[tuple[int, int]]:
    """Top left corners, row by row; the stride is the tile less the overlap."""
    step = max(1, tile - overlap)
    return [(r, c) for r in range(0, height, step) for c in range(0, width, step)]


def segment_tiles(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, top, left, row, col, label) from float64 tiles (image_id, top, left, h, w, data BINARY): ``model`` labels every tile on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples():
                mask = model(np.frombuffer(t.data, np.float64).reshape(t.h, t.w))
                r, c = np.nonzero(mask)
                yield pd.DataFrame({"image_id": t.image_id, "top": t.top, "left": t.left, "row": (r + t.top).astype(np.int32), "col": (c + t.left).astype(np.int32), "label": mask[r, c].astype(np.int32)})

    return tiles.mapInPandas(run, "image_id long, top int, left int, row int, col int, label int")


def segment_images(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int = 512, overlap: int = 64, least: float = 0.5) -> DataFrame:
    """(image_id, row, col, label) from float64 images (image_id, h, w, data BINARY), from grid to merged mask.

    ``model`` labels one tile at a time; tiles are merged in order, and a cell in the overlap of two is one cell. An
    image is worked on by one task, which holds its pixels and its mask; images are dealt to tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for im in b.itertuples():
                image = np.frombuffer(im.data, np.float64).reshape(im.h, im.w)
                tiles = [(r, c, np.asarray(model(image[r : r + tile, c : c + tile]), np.int32)) for r, c in tile_grid(im.h, im.w, tile, overlap)]
                mask = merge_tiles(tiles, (im.h, im.w), least)
                r, c = np.nonzero(mask)
                yield pd.DataFrame({"image_id": im.image_id, "row": r.astype(np.int32), "col": c.astype(np.int32), "label": mask[r, c]})

    return images.select("image_id", "h", "w", "data").mapInPandas(run, "image_id long, row int, col int, label int")


def threshold_model(level: float) -> Callable[[np.ndarray], np.ndarray]:
    """A model that labels the 4-connected parts of what is brighter than ``level``."""

    def model(image: np.ndarray) -> np.ndarray:
        live = image > level
        out, last = np.zeros(image.shape, np.int32), 0
        for r, c in zip(*np.nonzero(live)):
            if out[r, c]:
                continue
            last += 1
            stack = [(r, c)]
            while stack:
                i, j = stack.pop()
                if 0 <= i < image.shape[0] and 0 <= j < image.shape[1] and live[i, j] and not out[i, j]:
                    out[i, j] = last
                    stack += [(i + a, j + b) for a, b in _FOUR]
        return out

    return model
