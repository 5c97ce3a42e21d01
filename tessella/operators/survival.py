"""Survival: splits, product-limit curves, log-rank tests and Cox regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_pvalue, normal_tail
from ..model import ratio


def split(samples: DataFrame, value: str, by: list[str] | None = None, how: str = "median") -> DataFrame:
    """``samples`` with ``group``: High from the median up, else Low; or by tertiles, the middle third left out."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    if how == "median":
        return samples.withColumn("group", F.when(F.col(value) >= F.percentile(value, 0.5).over(w), "High").otherwise("Low"))
    if how != "tertile":
        raise ValueError(f"no split {how!r}")
    cut = samples.withColumns({"__lo": F.percentile(value, 1 / 3).over(w), "__hi": F.percentile(value, 2 / 3).over(w)})
    return cut.withColumn("group", F.when(F.col(value) >= F.col("__hi"), "High").when(F.col(value) <= F.col("__lo"), "Low")).where("group is not null").drop("__lo", "__hi")


def risk_table(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by..., time, events, at_risk): at risk are those whose time is not earlier."""
    t = samples.groupBy(*by, "time").agg(F.sum("event").alias("events"), F.count("*").alias("n"))
    later = Window.partitionBy(*by).orderBy(F.desc("time"))
    return t.withColumn("at_risk", F.sum("n").over(later)).select(*by, "time", "events", "at_risk")


def kaplan_meier(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by..., time, events, at_risk, survival): the product of 1 - events / at risk; 0 once all at risk have died."""
    before = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    r = risk_table(samples, by)
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(before)
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    return r.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(step).over(before))))


def logrank(samples: DataFrame, group: str = "group", by: list[str] | None = None, pvalue: bool = True) -> DataFrame:
    """(by..., observed, expected, variance, chi2[, p]) of the group that comes last in order against the other."""
    by = by or []
    key = by or ["__all"]
    s = samples if by else samples.withColumn("__all", F.lit(1))
    last = F.max(group).over(Window.partitionBy(*key))
    t = s.withColumn("__in", (F.col(group) == last).cast("int")).groupBy(*key, "time").agg(F.sum("event").alias("d"), F.count("*").alias("m"), F.sum(F.col("event") * F.col("__in")).alias("d1"), F.sum("__in").alias("m1"))
    later = Window.partitionBy(*key).orderBy(F.desc("time"))
    t = t.withColumns({"n": F.sum("m").over(later), "n1": F.sum("m1").over(later)}).where("d > 0")
    expected = F.col("d") * F.col("n1") / F.col("n")
    variance = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    out = t.groupBy(*key).agg(F.sum("d1").cast("double").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    out = out.withColumn("chi2", ratio(gap * gap, F.col("variance")))
    if pvalue:
        out = out.withColumn("p", chi2_pvalue("chi2"))
    return out if by else out.drop("__all")


def cox_fit(time: np.ndarray, event: np.ndarray, x: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(beta, se) of one covariate by Newton's method on Efron's partial likelihood; NaN where it doesn't converge."""
    order = np.argsort(-time, kind="stable")
    time, event, x = time[order], event[order].astype(bool), x[order]
    x = x - x.mean()
    beta = 0.0
    ends = np.r_[np.flatnonzero(np.diff(time)) + 1, len(time)]
    info = 0.0
    for _ in range(rounds):
        w = np.exp(np.clip(beta * x, -700, 700))
        s0, s1, s2 = np.cumsum(w), np.cumsum(w * x), np.cumsum(w * x * x)
        score = info = 0.0
        start = 0
        for end in ends:
            dead = np.arange(start, end)[event[start:end]]
            start = end
            if not len(dead):
                continue
            d0, d1, d2 = w[dead].sum(), (w[dead] * x[dead]).sum(), (w[dead] * x[dead] ** 2).sum()
            score += x[dead].sum()
            f = np.arange(len(dead)) / len(dead)
            a0, a1, a2 = s0[end - 1] - f * d0, s1[end - 1] - f * d1, s2[end - 1] - f * d2
            score -= (a1 / a0).sum()
            info += (a2 / a0 - (a1 / a0) ** 2).sum()
        if not np.isfinite(info) or info <= 1e-12:
            return float("nan"), float("nan")
        step = score / info
        beta += float(np.clip(step, -5, 5))
        if abs(step) < 1e-10:
            return beta, float(1 / np.sqrt(info))
    return float("nan"), float("nan")


def cox(samples: DataFrame, by: str = "protein", value: str = "value") -> DataFrame:
    """(by, beta, se, z, p): a Cox regression a group, each on one task; null where it fails."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[["time", "event", value]].notna().all(axis=1)
        beta, se = cox_fit(*(pdf.loc[ok, c].to_numpy(float) for c in ("time", "event", value))) if ok.sum() > 1 else (float("nan"),) * 2
        z = beta / se if se == se and se > 0 else float("nan")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "beta": [beta], "se": [se], "z": [z], "p": normal_tail(np.array([z]))})

    out = samples.select(by, "time", "event", value).groupBy(by).applyInPandas(fit, f"{by} {dict(samples.dtypes)[by]}, beta double, se double, z double, p double")
    return out.select(by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("beta", "se", "z", "p")])


def join_survival(values: DataFrame, survival: DataFrame) -> DataFrame:
    """Values (sample, ...) with time and event; an error if no sample is in both."""
    out = values.join(survival, "sample")
    if out.isEmpty():
        raise ValueError("no sample is in both tables")
    return out
