"""Quality classifier: linear support vectors over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw

#: Labelled documents that the models are fitted on, drawn by a hash of the id.
SAMPLE = 6_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str) -> set:
    """Indicators: words and runs of signs, pairs of them, and how many different ones (up to 8) follow themselves."""
    tokens = _TOKEN.findall(text.lower())
    out: set = set(zip(tokens, tokens[1:]))
    out.add(min(8, sum([a == b for a, b in out])))
    out.update(tokens)
    return out


class Model:
    """Weights by feature and an intercept; the margin of a text is their sum over its indicators, scaled to unit length."""

    def __init__(self, weights: dict, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def margin(self, found: set) -> float:
        hits = found & self.weights.keys()
        return math.fsum(map(self.weights.__getitem__, hits)) / math.sqrt(len(hits)) + self.bias if hits else self.bias


def vocabulary(texts: list[str], min_df: int = 4) -> tuple[list, list[np.ndarray]]:
    """The features that at least ``min_df`` texts have, and their numbers for each text.

    Most features are rare, so they are counted by hash first, and only those of full enough buckets get a number.
    """
    mask = (1 << 22) - 1
    buckets = np.zeros(mask + 1, np.int32)
    for t in texts:
        f = features(t)
        buckets[np.unique(np.fromiter(map(hash, f), np.int64, len(f)) & mask)] += 1
    often = (buckets >= min_df).tobytes()
    at: dict = {}
    rows = [np.array([at.setdefault(f, len(at)) for f in features(t) if often[hash(f) & mask]], np.int64) for t in texts]
    df = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]), minlength=len(at))
    number = np.where(df >= min_df, np.cumsum(df >= min_df) - 1, -1)
    rows = [n[n >= 0] for n in (number[r] for r in rows)]
    return [f for f, i in at.items() if number[i] >= 0], rows


def fit(names: list, rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, beta: float = 0.25, passes: int = 12, seed: int = 5) -> Model | None:
    """A model that is positive for y = 1; None where only one class is present. ``rows``: numbers of the features of each text.

    The dual of the hinge-loss problem is solved by coordinate descent; classes weigh alike.
    """
    y = np.asarray(y)
    if len(np.unique(y)) < 2 or not names:
        return None
    p, q = np.ones(len(names)), np.ones(len(names))
    for r, label in zip(rows, y):
        (p if label == 1 else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(sign == s).mean() for s in (1.0, -1.0)])
    most = np.where(sign > 0, 0.5 / share[0], 0.5 / share[1]) * c
    values = [ratio[r] / math.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v for v in values]) + 1.0
    w, b, alpha = np.zeros(len(names)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                worst = max(worst, abs(step))
                alpha[i] = new
                w[r] += step * v
                b += step
        if worst < 1e-3:
            break
    w = (1 - beta) * np.abs(w).mean() + beta * w
    scaled = w * ratio
    margins = np.array([scaled[r].sum() / math.sqrt(max(1, len(r))) for r in rows])
    return Model({f: float(x) for f, x in zip(names, scaled)}, -_between(margins, y == 1))


def _between(margins: np.ndarray, positive: np.ndarray) -> float:
    """The middle of the widest gap of those that part the classes with the fewest errors, classes weighing alike."""
    order = np.argsort(margins, kind="stable")
    m, p = margins[order], positive[order]
    wrong = np.cumsum(p) / max(1, p.sum()) + (np.cumsum(~p[::-1])[::-1] - ~p) / max(1, (~p).sum())
    wrong, gap = wrong[:-1], np.diff(m)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    at = best[np.argmax(gap[best])]
    return float((m[at] + m[at + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, Model | None]:
    """Models of quality and of toxicity from at most ``sample`` labelled documents.

    A document that is labelled more than once counts with its lower quality and higher toxicity. Rows with a null id,
    label or text are not used.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drawn = draw(marks, labels.agg(F.count_distinct("doc_id")).first()[0], sample, "doc_id")
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    # the sample is bounded, so it may be broadcast; repeated ids give one text
    got = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    names, rows = vocabulary(got["text"].tolist())
    models = []
    for column in ("quality", "toxic"):
        use = got[column].notna().to_numpy()
        models.append(fit(names, [r for r, u in zip(rows, use) if u], got.loc[use, column].astype(int).to_numpy()))
    return tuple(models)


def _margins(texts: pd.Series, models: tuple[Model | None, Model | None]) -> tuple[list, list]:
    quality, toxic = [], []
    for t in texts:
        found = features(t) if t else None
        worded = found is not None and len(found) > 1
        for m, out in zip(models, (quality, toxic)):
            out.append(m.margin(found) if m and worded else (0.0 if worded else math.nan))
    return quality, toxic


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality_margin, toxic_margin, keep) for every row of ``docs``.

    ``keep`` holds where the quality margin is not negative and the toxicity margin is not positive. A text without
    a word or sign, a null one included, has null margins and is not kept. Where the labels are of one class or
    none, the margin is 0 and does not count against a document. Repeated rows are scored alike; of ``labels`` only the
    columns doc_id, quality and toxic are read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    @F.pandas_udf("quality_margin double, toxic_margin double")
    def score(texts: pd.Series) -> pd.DataFrame:
        quality, toxic = _margins(texts, shared.value)
        return pd.DataFrame({"quality_margin": quality, "toxic_margin": toxic}, dtype=float)

    scored = docs.select("doc_id", "text").select("doc_id", score("text").alias("s"))
    q, t = (F.when(~F.isnan(c), c) for c in (F.col("s.quality_margin"), F.col("s.toxic_margin")))
    return scored.select("doc_id", q.alias("quality_margin"), t.alias("toxic_margin"), F.coalesce((q >= 0) & (t <= 0), F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns, whatever those are called beside ``doc_id`` and ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        quality, toxic = _margins(texts, shared.value)
        return pd.Series((np.array(quality) >= 0) & (np.array(toxic) <= 0))

    return docs.where(kept(F.col("text")))
