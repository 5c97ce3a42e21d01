"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts a language that a dictionary is made of, and bytes of whole ones that it holds.
SAMPLE = 400
DICTIONARY = 1 << 17
#: Bytes that are compressed at a time; a longer text would become its own dictionary.
PIECE = 2048
LEVEL = 3
#: The least difference between the two smallest sizes, as a share of the smallest.
MARGIN = 0.02
UNKNOWN = "und"


def _drawn(docs: DataFrame, sample: int, size: int, folds: int) -> pd.DataFrame:
    """(fold, lang, text) in order: of the ``sample`` labelled texts of each language and fold whose id has the least hash, those that ``fitting`` takes.

    Their sizes come to the driver first, and then only the texts that are taken.
    """
    h = F.xxhash64("text")
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    rows = rows.select(F.pmod(h, F.lit(folds)).alias("fold"), F.col("lang").cast("string").alias("lang"), "doc_id", h.alias("h"), "text")
    pick = Window.partitionBy("fold", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ids = rows.select("fold", "lang", "doc_id", "h", (F.octet_length(F.lower("text")) + 1).alias("bytes")).distinct()
    ids = ids.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= sample).toPandas()
    taken = [part.iloc[fitting(part["h"].tolist(), part["bytes"].tolist(), size)] for _, part in ids.sort_values(["fold", "lang", "rn"]).groupby(["fold", "lang"])]
    if not taken:
        return pd.DataFrame({"fold": [], "lang": [], "text": []})
    keys = docs.sparkSession.createDataFrame(pd.concat(taken)[["lang", "doc_id", "h", "rn"]], "lang string, doc_id long, h long, rn int")
    # at most ``sample`` ids a language and fold
    got = rows.join(F.broadcast(keys), ["lang", "doc_id", "h"]).select("fold", "lang", "rn", "text").distinct()
    return got.toPandas().sort_values(["fold", "lang", "rn", "text"])


def fitting(texts: list, sizes: list[int], size: int) -> list[int]:
    """Places of different texts, each if it still fits into ``size`` bytes; the first in any case if none fits."""
    out, seen, used = [], set(), 0
    for i, (t, n) in enumerate(zip(texts, sizes)):
        if t not in seen and used + n <= size:
            seen.add(t)
            out.append(i)
            used += n
    return out or [0][: len(texts)]


def _content(texts: Iterable[str]) -> bytes:
    """Whole texts in lower case, one after the other."""
    return b"".join(t.lower().encode() + b"\n" for t in texts)


def dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw content by language from whole texts of at most ``sample`` labelled documents each, drawn by a hash of the id."""
    return {str(lang): _content(part["text"]) for lang, part in _drawn(docs, sample, size, 1).groupby("lang")}


def fold_dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> list[dict[str, bytes]]:
    """Dictionaries for the texts of each of two folds by a hash of the text, made of texts of the other fold only."""
    out: list[dict[str, bytes]] = [{}, {}]
    for (fold, lang), part in _drawn(docs, sample, size, 2).groupby(["fold", "lang"]):
        out[1 - int(fold)][str(lang)] = _content(part["text"])
    return out


@lru_cache(maxsize=4)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in content:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def sizes(text: str, content: tuple[tuple[str, bytes], ...]) -> list[tuple[int, str]]:
    """(bytes, language), smallest first: the whole text in lower case, piece by piece, compressed with each dictionary."""
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // PIECE))
    cut = -(-len(raw) // n) if raw else 1
    pieces = [raw[i : i + cut] for i in range(0, len(raw), cut)]
    return sorted((sum([len(c.compress(p)) for p in pieces]), lang) for lang, c in _compressors(content))


def identify(docs: DataFrame, dicts: dict[str, bytes] | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, language, best_bytes, margin) for every row of ``docs``.

    Without given dictionaries they are made of the labelled rows of ``docs``, in two folds, so that no text is scored
    by a dictionary that holds it or an exact copy of it. ``margin`` is how much larger the second smallest size is, as
    a share of the smallest. ``language`` is ``und`` where it is below the least margin, so for ties, texts too short to
    tell and texts of two languages. Null and empty texts are ``und`` with null sizes, as is every text where fewer than
    two languages have dictionaries. Repeated rows give equal rows; other columns play no part; an empty table gives none.
    """
    folds = fold_dictionaries(docs) if dicts is None else [dicts]
    shared = docs.sparkSession.sparkContext.broadcast([tuple(sorted(d.items())) for d in folds])

    @F.pandas_udf("language string, best_bytes long, margin double")
    def score(texts: pd.Series, fold: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(texts, fold):
            if not t or len(shared.value[f]) < 2:
                rows.append((UNKNOWN, None, None))
                continue
            (best, lang), (second, _) = sizes(t, shared.value[f])[:2]
            m = (second - best) / best
            rows.append((lang if m >= margin else UNKNOWN, best, m))
        out = pd.DataFrame(rows, columns=["language", "best_bytes", "margin"])
        return out.astype({"best_bytes": "Int64", "margin": "Float64"})

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(len(folds))).cast("int").alias("fold"))
    return rows.select("doc_id", score("text", "fold").alias("s")).select("doc_id", "s.language", "s.best_bytes", "s.margin")
