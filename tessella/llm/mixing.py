"""Mixing sources to target weights by hash thresholds.

Every document has a hash in [0, 2^60) that only its id decides. A source keeps the documents below its threshold,
found from histograms of tokens by hash bucket: cumulate the buckets, refine the one where the budget is crossed,
and filter. Documents are never sorted, and a larger budget keeps a superset of what a smaller one keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, columns, fresh, sized, stage, word_count

HASH_BITS = 60
BUCKET_BITS = 15
#: Share of all tokens up to which the scarcest sources together don't set the scale, and the least share that is kept.
NEGLIGIBLE = 0.01
RETAIN = 0.75


def id_hash(doc_id: Column, seed: str = "mix") -> Column:
    """The first 60 bits of md5 of seed and id; of the seed alone for a null id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def budgets(totals: DataFrame, power: float, weights: dict[str, float] | None, retain: float | None = None) -> DataFrame:
    """(source, budget) such that the budgets stand in the target weights and the scarcest source is used up.

    The weight of a source is given, or its number of tokens to ``power``. Sources without a weight or tokens get 0.
    At least a share ``retain`` of the weighed tokens is kept: where the scarcest source leaves less, the budgets of the
    others grow in the target weights, and those that run out stay whole below their target. Without given weights,
    ``retain`` is ``RETAIN`` and the scarcest sources of at most ``NEGLIGIBLE`` of all tokens together stay whole and
    scale no other; given weights are followed to the letter unless ``retain`` is given as well.
    """
    negligible, least = (NEGLIGIBLE, RETAIN) if weights is None else (0.0, 0.0)
    least = least if retain is None else retain
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(power))
    else:
        weight = F.lit(None).cast("double")
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = totals.withColumn("w", F.when(F.col("tokens") > 0, weight))
    # by scarcity; one task, as sources are few
    order = Window.orderBy("ratio")
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = weighed.where("w > 0").withColumn("ratio", F.col("tokens") / F.col("w"))
    ranked = ranked.select("ratio", "tokens", F.sum("tokens").over(upto).alias("upto"), F.sum("w").over(onward).alias("rest"), F.sum("tokens").over(Window.partitionBy()).alias("total"))
    scarcest = F.min(F.when(F.col("upto") > F.col("total") * F.lit(negligible), F.col("ratio")))
    # with the scarcer ones whole, the scale at which the rest fill up the total; the largest of them is the one that does
    filled = F.max((F.col("total") * F.lit(float(least)) - (F.col("upto") - F.col("tokens"))) / F.col("rest"))
    scale = ranked.agg(F.greatest(scarcest, filled).alias("scale"))
    budget = F.coalesce(F.floor(F.col("w") * F.col("scale") + F.lit(1e-6)), F.lit(0)).cast("long")
    return weighed.crossJoin(F.broadcast(scale)).select("source", F.least(budget, F.col("tokens")).alias("budget"))


def thresholds(meta: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, below): keep hashes under ``below``. ``meta``: staged (source, h, tokens)."""
    whole = 1 << HASH_BITS
    left = budget.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("below"))
    shift = HASH_BITS
    while shift > 0:
        shift -= BUCKET_BITS
        parent = F.shiftright("m.h", shift + BUCKET_BITS)
        m, b = meta.alias("m"), left.where("below is null").alias("b")
        inside = m.join(sized(b, 100_000), F.col("m.source").eqNullSafe(F.col("b.source")) & (parent == F.col("b.prefix")))
        hist = inside.groupBy(F.col("b.source").alias("s"), F.shiftright("m.h", shift).alias("bucket")).agg(F.sum("tokens").alias("t"), F.first("budget").alias("most"))
        cum = hist.withColumn("cum", F.sum("t").over(Window.partitionBy("s").orderBy("bucket")))
        crossed = F.min(F.when(F.col("cum") > F.col("most"), F.col("bucket"))).alias("at")
        used = F.coalesce(F.max(F.when(F.col("cum") <= F.col("most"), F.col("cum"))), F.lit(0)).alias("used")
        step = cum.groupBy("s").agg(crossed, used)
        # where no bucket crosses the budget, the parent stays as a whole and the source is settled
        end = F.least(F.shiftleft(F.col("prefix") + 1, shift + BUCKET_BITS), F.lit(whole))
        left = stage(
            left.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"),
                F.coalesce("at", F.lit(0)).alias("prefix"),
                F.coalesce("below", F.when(F.col("at").isNull(), end)).alias("below"),
            ),
            "thresholds",
        )
    return left.select("source", F.coalesce("below", "prefix").alias("below"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", retain: float | None = None) -> DataFrame:
    """The rows of ``docs`` that bring the tokens of the sources to their target weights; see ``budgets`` for how many.

    Tokens are words between white space. Of each source, rows stay in order of their hash as long as the sum of
    tokens, ties of the hash included, is within the source's budget: rows with one id stay or go together. A null
    source is a source of its own; a null text has no tokens; null ids share a hash. Sources are few (their budgets
    are broadcast after a check of their number). Columns stay as they are, whatever their names; an empty table stays
    empty.
    """
    hash_c, below_c, source_c = fresh(docs, "h", "below", "source")
    meta = stage(docs.select(col(source).alias("source"), id_hash(col(id_col), seed).alias("h"), word_count(col(text)).alias("tokens")), "meta")
    totals = stage(meta.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    cuts = thresholds(meta, budgets(totals, power, weights, retain))
    keyed = docs.withColumn(hash_c, id_hash(col(id_col), seed))
    cuts = sized(cuts.select(F.col("source").alias(source_c), F.col("below").alias(below_c)))
    hit = keyed.join(cuts, col(source).eqNullSafe(F.col(source_c)) & (F.col(hash_c) < F.col(below_c)), "left_semi")
    return hit.select(columns(docs))
