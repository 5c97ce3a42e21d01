"""Ranks, adjustments, correlations and tests as window and aggregate expressions; tails of distributions in NumPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import cut, ratio


def average_rank(partition: list[str], value: str) -> Column:
    """Rank of ``value`` within the partition from 1, ties sharing the mean."""
    same = Window.partitionBy(*partition, value)
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(same) - 1) / 2.0


def bh_adjust(df: DataFrame, p: str, by: list[str] | None = None, out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg: the running least of p n / rank from the largest p down, at most 1. Null p stay null.

    Equal p have one adjusted value, so that ranks are taken over distinct p with their counts; rows only meet theirs in
    a join. Within groups ``by`` the rows of a group are ranked together.
    """
    if not by:
        rows = cut(df)
        sizes = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k"))
        up = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = sizes.withColumns({"__rank": F.sum("__k").over(up), "__n": F.sum("__k").over(Window.partitionBy())})
        value = F.least(F.min(F.col("__p") * F.col("__n") / F.col("__rank")).over(down), F.lit(1.0))
        return rows.join(ranked.select("__p", value.alias(out)), F.col(p) == F.col("__p"), "left").drop("__p")
    known = F.col(p).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    n = F.count("*").over(Window.partitionBy(*by, known))
    raw = df.withColumns({"__rank": rank, "__n": n})
    down = Window.partitionBy(*by, F.col(p).isNotNull()).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    value = F.least(F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(down), F.lit(1.0))
    return raw.withColumn(out, F.when(known, value)).drop("__rank", "__n")


def pearson(x: str, y: str) -> Column:
    """Correlation from sums, null where one side is constant."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).cast("double")
    sxy = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    sxx, syy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.when((sxx > 1e-12) & (syy > 1e-12), sxy / F.sqrt(sxx * syy))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., rho, n)"""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranked.withColumns({"__x": average_rank(by, x), "__y": average_rank(by, y)})
    return ranked.groupBy(*by).agg(pearson("__x", "__y").alias("rho"), F.count("*").alias("n"))


def cohens_d(group: Column, value: Column) -> Column:
    """Difference of the means of true and false over the pooled standard deviation; 0 for fewer than two values or no spread."""
    a, b = F.when(group, value), F.when(~group, value)
    n, m = F.count(a), F.count(b)
    pooled = F.sqrt(((n - 1) * F.coalesce(F.var_samp(a), F.lit(0.0)) + (m - 1) * F.coalesce(F.var_samp(b), F.lit(0.0))) / F.greatest(n + m - 2, F.lit(1)))
    return F.when((n < 2) | (m < 2) | (pooled == 0), 0.0).otherwise(ratio(F.avg(a) - F.avg(b), pooled))


def welch_t(group: Column, value: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of true against false; null where there is no spread."""
    a, b = F.when(group, value), F.when(~group, value)
    va, vb = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    t = F.try_divide(F.avg(a) - F.avg(b), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1))
    return t, df


def significant(value: Column, digits: int) -> Column:
    """Rounded to so many significant digits, half to even."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.rint(value * scale) / scale)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, log: bool = False) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, or its logarithm, which does not run out of range."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    lg = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z) - np.log(p)
        tiny = 1e-300
        f, c, d = np.ones_like(z), np.ones_like(z), np.zeros_like(z)
        for i in range(400):
            m = i // 2
            if i == 0:
                num = np.ones_like(z)
            elif i % 2 == 0:
                num = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            else:
                num = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
            step = c * d
            f = f * step
            if np.nanmax(np.abs(step - 1), initial=0) < 1e-14:
                break
        logs = np.where(z <= 0, -np.inf, front + np.log(f - 1))
        if log:
            return np.where(swap, np.log1p(-np.exp(logs)), logs)
        return np.where(swap, 1 - np.exp(logs), np.exp(logs))


def f_log_tail(x: np.ndarray, n: float, m: float) -> np.ndarray:
    """Logarithm of the upper tail of the F distribution."""
    return betainc(m / 2, n / 2, m / (m + n * np.asarray(x, float)), log=True)


def chi2_quantile(tail: np.ndarray, df: float) -> np.ndarray:
    """Where the upper tail of chi-squared is ``tail``, by the normal approximation of the cube root; infinite for a tail of 0."""
    normal = NormalDist().inv_cdf
    z = np.array([np.inf if t <= 0 else -np.inf if t >= 1 else -normal(t) for t in np.asarray(tail, float)])
    c = 2 / (9 * df)
    return df * np.maximum(1 - c + z * math.sqrt(c), 0) ** 3


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t."""
    t = np.asarray(t, float)
    with np.errstate(all="ignore"):
        return betainc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))


def chi2_tail_1(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared with one degree of freedom."""
    return np.vectorize(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)) if v == v else math.nan, otypes=[float])(x)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Two-sided p of a standard normal."""
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan, otypes=[float])(z)


#: Rows up to which order statistics come from one histogram of all values; of more, only a bracket is looked at exactly.
HISTOGRAM = 1_000_000


def order_statistics(df: DataFrame, value: str, ranks: list[int], n: int) -> list:
    """The values of the given ranks, from 1, of a column of ``n`` values without nulls."""

    def exact(rows: DataFrame, wanted: list[int], size: int) -> list:
        # percentile_disc takes the least value that at least the share p of all don't exceed: of rank ceil(p n)
        parts = [F.expr(f"percentile_disc({(r - 0.5) / size!r}) within group (order by __v)").alias(f"r{i}") for i, r in enumerate(wanted)]
        return list(rows.agg(*parts).first())

    rows = df.select(F.col(value).alias("__v"))
    if n <= HISTOGRAM:
        return exact(rows, ranks, n)
    out = []
    shares = [s for r in ranks for s in (max(r / n - 3e-4, 0.0), min(r / n + 3e-4, 1.0))]
    ends = rows.agg(F.percentile_approx("__v", shares, F.lit(10_000))).first()[0]
    for i, r in enumerate(ranks):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        below = rows.where(F.col("__v") < lo).count()
        inside = rows.where(F.col("__v").between(lo, hi))
        size = inside.count()
        # the approximation's error is a third of the bracket; should it be larger, all values are looked at
        out += exact(inside, [r - below], size) if 0 < r - below <= size else exact(rows, [r], n)
    return out


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t.to_numpy(float), df.to_numpy(float))).where(lambda p: p.notna(), None)


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(normal_tail(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail_1(x.to_numpy(float)))


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs."""
    df = (n - 2).cast("double")
    t = r * F.sqrt(F.try_divide(df, F.greatest(1 - r * r, F.lit(1e-300))))
    return t_pvalue(t, df)


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by..., u, z, n1, n2): rank-sum of ``group`` true against false, z with the correction for ties and continuity."""
    ranked = df.withColumn("__r", average_rank(by, value)).withColumn("__t", F.count("*").over(Window.partitionBy(*by, value)))
    g = F.col(group)
    out = ranked.groupBy(*by).agg(
        F.sum(F.when(g, F.col("__r"))).alias("r1"), F.count(F.when(g, 1)).cast("double").alias("n1"), F.count(F.when(~g, 1)).cast("double").alias("n2"), F.sum(F.col("__t") * F.col("__t") - 1).cast("double").alias("ties")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    gap = F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5
    return out.select(*by, u.alias("u"), ratio(gap, sd).alias("z"), "n1", "n2")


def wilcoxon(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., w, z, n): signed ranks of ``value`` against 0, zeros left out; z by the normal approximation for a shift above 0."""
    live = df.where(F.col(value) != 0).withColumn("__a", F.abs(value))
    ranked = live.withColumn("__r", average_rank(by, "__a")).withColumn("__t", F.count("*").over(Window.partitionBy(*by, "__a")))
    out = ranked.groupBy(*by).agg(F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0)).alias("w"), F.count("*").cast("double").alias("n"), F.sum(F.col("__t") * F.col("__t") - 1).cast("double").alias("ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    return out.select(*by, "w", ratio(F.col("w") - mean, sd).alias("z"), "n")
