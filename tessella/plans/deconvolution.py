"""Deconvolution from counts to fractions: the malignant part first, then lineages and subtypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import cut
from ..operators import deconvolution as d
from ..operators.expression import expressed, log2_tpm, quality_control

#: Spots from which the malignant part comes from two rounds of correlation in place of clusters.
LARGE = 20_000


def malignant_by_clusters(expr: DataFrame, cells: DataFrame, signatures: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(fractions, chosen spots): the first signature (gene_id, weight) for which a cluster is malignant gives the chosen
    spots, those of such clusters whose correlation is above 0; without any, the twentieth of the spots of the most
    genes. Fractions are the correlation with the mean centred profile of the chosen, clipped and stretched.
    """
    clusters = cut(d.cluster_cells(expr, cells))
    depth = cut(quality_control(cells, expr, 0))
    chosen = None
    for s in signatures:
        r = cut(d.signature_correlation(expr, s, cells))
        good = d.cluster_stats(clusters, r, depth).where("malignant").select("cluster")
        if not good.isEmpty():
            chosen = clusters.join(good, "cluster").join(r.where("r > 0"), "cell_id", "left_semi").select("cell_id")
            break
    if chosen is None:
        chosen = depth.orderBy(F.desc("genes"), "cell_id").limit(_twentieth(depth.count())).select("cell_id")
    chosen = cut(chosen)
    return d.malignant_fraction(d.correlation_with(expr, cells, chosen)), chosen


def malignant_by_rounds(expr: DataFrame, cells: DataFrame, signature: DataFrame, at: int = 100) -> tuple[DataFrame, DataFrame]:
    """The same without clusters, for many spots: the correlation with the signature, clipped at its ``at``-th from either end
    and stretched, gives the spots at 1; the correlation with their mean centred profile, clipped and stretched alike, gives
    the fractions, and its spots at 1 are the chosen ones.
    """
    expr = cut(expr)
    first = d.malignant_fraction(d.signature_correlation(expr, signature, cells), at)
    second = cut(d.malignant_fraction(d.correlation_with(expr, cells, cut(first.where("fraction >= 1").select("cell_id"))), at))
    return second, second.where("fraction >= 1").select("cell_id")


def malignant_bulk(expr: DataFrame, samples: DataFrame, signature: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for bulk samples: of as many samples as have r > 0 and an adjusted p below 0.25, or a twentieth if those are
    fewer, the ones of the highest correlation with the signature are chosen.
    """
    expr = cut(expr)
    r = cut(d.signature_correlation(expr, signature, samples))
    n = max(_twentieth(r.count()), r.where("r > 0 and p_adj < 0.25").count())
    chosen = cut(r.orderBy(F.desc_nulls_last("r"), "cell_id").limit(n).select("cell_id"))
    return d.malignant_fraction(d.correlation_with(expr, samples, chosen)), chosen


def _twentieth(n: int) -> int:
    return max(1, round(0.05 * n))


def deconvolution(expr: DataFrame, cells: DataFrame, reference: DataFrame, lineage: DataFrame, marks: DataFrame, signatures: list[DataFrame], adjacent_normal: bool = False) -> DataFrame:
    """(cell_id, cell_type, fraction) with the malignant part; for adjacent normal tissue without it."""
    expr = cut(expressed(expr))
    if adjacent_normal:
        return d.deconvolve(expr, cells, reference, lineage, marks)
    small = cells.count() < LARGE
    fractions, chosen = malignant_by_clusters(expr, cells, signatures) if small else malignant_by_rounds(expr, cells, signatures[0])
    return d.deconvolve(expr, cells, reference, lineage, marks, fractions, d.malignant_reference(expr, chosen))


def deconvolution_bulk(expr: DataFrame, samples: DataFrame, reference: DataFrame, lineage: DataFrame, marks: DataFrame, signature: DataFrame, purity: DataFrame | None = None) -> DataFrame:
    """Bulk samples: no clusters. A known purity (cell_id, fraction) takes the place of the inferred one; its profile is that of the purest twentieth."""
    expr = cut(expressed(expr))
    if purity is None:
        fractions, chosen = malignant_bulk(expr, samples, signature)
    else:
        least = purity.agg(F.percentile("fraction", 0.95).alias("least"))
        fractions, chosen = purity, purity.crossJoin(F.broadcast(least)).where(F.col("fraction") >= F.col("least")).select("cell_id")
    return d.deconvolve(expr, samples, reference, lineage, marks, fractions, d.malignant_reference(expr, chosen))


def reference_from_cells(sc_expr: DataFrame, annotation: DataFrame, lineage: DataFrame, n_cells: int = 100) -> tuple[DataFrame, DataFrame]:
    """(reference, marks) of annotated single cells, at most so many of each type; see ``reference_markers`` for the marks."""
    d.validate_reference(sc_expr, annotation, lineage)
    few = cut(d.downsample(annotation, n_cells))
    expr = cut(sc_expr.join(few, "cell_id", "left_semi").select("cell_id", "gene_id", "value"))
    return d.generate_reference(expr, few, lineage), d.reference_markers(log2_tpm(expr), few, lineage)


def deconvolution_matched(expr: DataFrame, cells: DataFrame, sc_expr: DataFrame, annotation: DataFrame, lineage: DataFrame) -> DataFrame:
    """Fractions by a reference made of matched single cells, which has the malignant ones as a type of its own."""
    ref, marks = reference_from_cells(sc_expr, annotation, lineage)
    return d.deconvolve(cut(expressed(expr)), cells, cut(ref), lineage, cut(marks))


def deconvolution_malignant(expr: DataFrame, cells: DataFrame, fractions: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """The fractions with the malignant one parted into states: clusters of the spots at or above the cutoff, told apart by
    genes that are markers in exactly one comparison.
    """
    expr = cut(expressed(expr))
    states = cut(d.malignant_states(expr, cells, fractions, cutoff).select("cell_id", F.concat(F.lit("Malignant state "), F.col("cluster") + 1).alias("group")))
    names = sorted(r["group"] for r in states.select("group").distinct().collect())
    return _states(expr, cells, fractions, states, names)


def deconvolution_malignant_custom(expr: DataFrame, cells: DataFrame, fractions: DataFrame, sc_expr: DataFrame, annotation: DataFrame) -> DataFrame:
    """The same with states that annotated malignant cells (cell_id, group) bring."""
    names = sorted(r["group"] for r in annotation.select("group").distinct().collect())
    return _states(cut(expressed(expr)), cells, fractions, annotation, names, sc_expr)


def _states(expr: DataFrame, cells: DataFrame, fractions: DataFrame, groups: DataFrame, names: list[str], source: DataFrame | None = None) -> DataFrame:
    source = expr if source is None else source
    lineage = expr.sparkSession.createDataFrame([(d.MALIGNANT, n) for n in names], "major string, sub string")
    ref = cut(d.generate_reference(source, groups.withColumnRenamed("group", "sub"), lineage))
    logged = cut(log2_tpm(source))
    found = None
    for n in names if len(names) > 1 else []:
        m = d.welch_markers(logged, groups, n).select(F.lit(n).alias("cell_type"), "gene_id")
        found = m if found is None else found.unionByName(m)
    if found is None:
        found = ref.select("cell_type", "gene_id")
    else:
        once = found.groupBy("gene_id").count().where("count = 1").select("gene_id")
        found = found.join(once, "gene_id", "left_semi")
    parts = d.deconvolve(expr, cells, ref, lineage, cut(found), unidentifiable=False)
    malignant = fractions.where(F.col("cell_type") == d.MALIGNANT).select("cell_id", F.col("fraction").alias("m"))
    share = parts.where(F.col("cell_type") != d.MALIGNANT).join(malignant, "cell_id").select("cell_id", "cell_type", (F.col("fraction") * F.col("m")).alias("fraction"))
    return fractions.select("cell_id", "cell_type", "fraction").unionByName(share)
