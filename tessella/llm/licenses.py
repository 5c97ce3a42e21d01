"""License scans by diagonal voting.

All runs of k words of every text meet the runs of the templates in a hash join. A hit votes for the diagonal
(position in the text less position in the template). Votes that follow each other on a diagonal make a stretch;
stretches of neighbouring diagonals, between which words were put in or left out, are merged if they go on in the
text and in the template alike, so that a notice that is repeated stays apart. Spans whose words agree well enough
count, and of overlapping ones the template that explains most words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col
from .license_texts import TEMPLATES

K = 3
#: Diagonals at most this far apart are neighbours, and words at most this many may be changed between two stretches.
SHIFT = 3
GAP = 8
#: Share of the span's words that must agree, and of the template's or of ``LEAST`` if that is fewer.
SHARE = 0.8
LEAST = 15
#: Words that at most this share of the short templates (of fewer than ``LEAST`` words) have tell them apart.
TELLING = 0.25


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def runs(templates: dict[str, str], k: int) -> list[tuple[str, int, int, str]]:
    """(template, its number of words, position, run of k words). Templates of fewer than k words have none."""
    out = []
    for name, text in templates.items():
        w = words(text)
        out += [(name, len(w), i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def telling(templates: dict[str, str]) -> dict[str, list[int]]:
    """Positions in each short template that have to agree: numbers, and words that few of the short templates have."""
    short = {n: w for n, t in templates.items() if len(w := words(t)) < LEAST}
    having = Counter(x for w in short.values() for x in set(w))
    return {n: [i for i, x in enumerate(w) if x.isdigit() or having[x] <= TELLING * len(short)] for n, w in short.items()}


def stretches(diagonal: int, votes: list[int], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(first word, last word, diagonal, votes) of the votes of a diagonal that are at most ``GAP`` words apart."""
    out: list[tuple[int, int, int, list[int]]] = []
    part: list[int] = []
    for p in sorted(votes):
        if part and p - part[-1] > GAP + k:
            out.append((part[0], part[-1] + k - 1, diagonal, part))
            part = []
        part.append(p)
    if part:
        out.append((part[0], part[-1] + k - 1, diagonal, part))
    return out


def chains(parts: list[tuple[int, int, int, list[int]]], k: int) -> list[list[tuple[int, int, int, list[int]]]]:
    """Stretches of one template, merged with the nearest one before that they go on from."""
    out: list[list[tuple[int, int, int, list[int]]]] = []
    open_: list[list[tuple[int, int, int, list[int]]]] = []
    for s in sorted(parts, key=lambda s: (s[0], s[2])):
        open_ = [c for c in open_ if s[0] - c[-1][1] <= GAP + 1]
        best = None
        for c in open_:
            _, last, diagonal, _ = c[-1]
            ahead, ahead_there = s[0] - last, (s[0] - s[2]) - (last - diagonal)
            if abs(s[2] - diagonal) <= SHIFT and -k < ahead and -k < ahead_there <= GAP + 1 and s[1] > last and s[1] - s[2] > last - diagonal and (best is None or last > best[-1][1]):
                best = c
        if best is None:
            best = []
            out.append(best)
            open_.append(best)
        best.append(s)
    return out


def spans(votes: list[tuple[str, int, int, list[int]]], k: int, tell: dict[str, list[int]]) -> list[tuple[str, int, int, int, int]]:
    """(template, first word, last word, matched words, template words) of a text's votes (template, its words, diagonal, positions).

    ``tell``: positions in templates that have to agree.
    """
    by: dict[tuple[str, int], list[tuple[int, int, int, list[int]]]] = {}
    for name, n, diagonal, positions in votes:
        by.setdefault((name, n), []).extend(stretches(diagonal, positions, k))
    found = []
    for (name, n), parts in by.items():
        for chain in chains(parts, k):
            cover = {p + j for s in chain for p in s[3] for j in range(k)}
            first, last = min(cover), max(cover)
            enough = len(cover) >= SHARE * min(n, LEAST) and len(cover) >= SHARE * (last - first + 1)
            if enough and (name not in tell or {p - s[2] + j for s in chain for p in s[3] for j in range(k)}.issuperset(tell[name])):
                found.append((name, first, last, len(cover), n))
    kept: list[tuple[str, int, int, int, int]] = []
    for s in sorted(found, key=lambda s: (-s[3], -s[3] / s[4], s[0], s[1])):
        if all(2 * (min(s[2], t[2]) - max(s[1], t[1]) + 1) < s[2] - s[1] + 1 for t in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, template, first_word, last_word, matched_words, template_words): where texts hold templates.

    Positions count the text's words (runs of letters and digits) from 0. A span needs ``SHARE`` of its words in
    agreeing runs, and of the template's or of ``LEAST`` if that is fewer; so a part of a long license is found too, and
    ``matched_words`` says how much of it. Of a template of fewer than ``LEAST`` words, numbers and the words that few of
    such templates have must all agree, so that no version stands for another. A template that occurs again gives
    another span. Of spans that share half of their words the one of most matched words stays, on a tie that of the
    shorter template. Null and empty texts and those of fewer than k words have none, and templates of fewer than k
    words are never found. Rows with a null id are scanned like any other; rows that repeat an id and a text give their
    spans once, and an id of several texts the spans of each; other columns play no part; an empty table gives none.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    library, tell = runs(templates, k), telling(templates)
    known = spark.createDataFrame(library, "template string, template_words int, at int, run string").withColumn("key", F.xxhash64("run")).withColumnRenamed("run", "same")
    clean = F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " "))
    split = docs.where(col(text).isNotNull()).select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("h"), F.split(clean, " ").alias("w"))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)]))
    grams = split.where(F.size("w") >= k).select("doc_id", "h", F.posexplode(each).alias("pos", "run"))
    hits = grams.withColumn("key", F.xxhash64("run")).join(F.broadcast(known) if len(library) <= BROADCAST_ROWS else known, "key").where("run = same")
    votes = hits.groupBy("doc_id", "h", "template", "template_words", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("pos").alias("votes"))
    by_text = votes.groupBy("doc_id", "h").agg(F.collect_list(F.struct("template", "template_words", "diagonal", "votes")).alias("votes"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, votes in zip(b["doc_id"], b["votes"]):
                given = [(v["template"], v["template_words"], v["diagonal"], v["votes"].tolist()) for v in votes]
                out += [(None if pd.isna(doc_id) else int(doc_id), *s) for s in spans(given, k, tell)]
            frame = pd.DataFrame(out, columns=["doc_id", "template", "first_word", "last_word", "matched_words", "template_words"])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, template string, first_word int, last_word int, matched_words int, template_words int"
    return by_text.select("doc_id", "votes").mapInPandas(find, schema)
