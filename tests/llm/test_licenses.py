import random
from difflib import SequenceMatcher

import pytest

from tessella.llm import licenses
from tessella.llm.licenses import TEMPLATES

SCHEMA = "doc_id long, text string, template string, pos int, `a.b` string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "t", 1, "n") for i, t in rows], SCHEMA)


def found(spark, rows, **kw):
    return {(r.doc_id, r.template, r.first_word, r.last_word) for r in licenses.scan(make(spark, rows), **kw).collect()}


def aligned(text, template, must):
    """(first, last, matched) of the places where a template stands in a text, by longest common blocks: no votes, no diagonals."""
    w, out = list(text), []
    while True:
        blocks = [b for b in SequenceMatcher(None, w, template, autojunk=False).get_matching_blocks() if b.size >= licenses.K]
        groups = []
        for b in blocks:
            a = groups[-1][-1] if groups else None
            if a and b.a - a.a - a.size <= licenses.GAP and b.b - a.b - a.size <= licenses.GAP and abs((b.a - b.b) - (a.a - a.b)) <= licenses.SHIFT:
                groups[-1].append(b)
            else:
                groups.append([b])
        if not groups:
            return out
        for g in groups:
            first, last, n = g[0].a, g[-1].a + g[-1].size - 1, sum(b.size for b in g)
            same = {b.b + j for b in g for j in range(b.size)}
            if n >= licenses.SHARE * min(len(template), licenses.LEAST) and n >= licenses.SHARE * (last - first + 1) and must <= same:
                out.append((first, last, n))
            for b in g:
                w[b.a : b.a + b.size] = [None] * b.size


def independent(rows, templates):
    out = set()
    short = [set(licenses.words(t)) for t in templates.values() if len(licenses.words(t)) < licenses.LEAST]
    must = {n: {i for i, x in enumerate(w) if x.isdigit() or sum(x in s for s in short) <= len(short) / 4} if len(w) < licenses.LEAST else set() for n, t in templates.items() for w in [licenses.words(t)]}
    for i, text in rows:
        w = licenses.words(text or "")
        cands = [(-n, -n / len(t), name, a, b) for name, full in templates.items() for t in [licenses.words(full)] if set(t) & set(w) for a, b, n in aligned(w, t, must[name])]
        kept = []
        for _, _, name, a, b in sorted(cands):
            if all(2 * len(set(range(a, b + 1)) & set(range(c, d + 1))) < b - a + 1 for _, c, d in kept):
                kept.append((name, a, b))
        out |= {(i, *k) for k in kept}
    return out


def test_documents_match_an_independent_finder(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 40_000]
    want = independent(rows, TEMPLATES)
    assert found(spark, rows) == want and want


def test_query_finds_the_notices_of_all_documents(spark, sf):
    from tessella.llm import queries

    got = {}
    for r in queries.op2_license_scan(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r.template)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = " ".join(licenses.words(r.text))
        for name in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved"):
            assert got.get(r.doc_id, []).count(name) == f" {text} ".count(f" {' '.join(licenses.words(TEMPLATES[name]))} ")


def test_every_template_is_found_as_itself(spark):
    rows = [(i, f"before it {TEMPLATES[n]} after it") for i, n in enumerate(TEMPLATES)]
    want = {(i, n, 2, 1 + len(licenses.words(TEMPLATES[n]))) for i, n in enumerate(TEMPLATES)}
    assert found(spark, rows) == want


def test_nested_licenses_are_told_apart(spark):
    bsd2, bsd3 = TEMPLATES["bsd-2-clause"], TEMPLATES["bsd-3-clause"]
    rows = [(1, bsd2), (2, bsd3), (3, bsd2 + " some words of another kind that part the two texts from each other " + bsd3)]
    n2, n3 = len(licenses.words(bsd2)), len(licenses.words(bsd3))
    assert found(spark, rows) == {(1, "bsd-2-clause", 0, n2 - 1), (2, "bsd-3-clause", 0, n3 - 1), (3, "bsd-2-clause", 0, n2 - 1), (3, "bsd-3-clause", n2 + 13, n2 + n3 + 12)}


def test_versions_and_variants_are_not_mixed_up(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 2."),
        (2, "This work is licensed under the GNU General Public License, version 9."),
        (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "Licensed under CC BY 4.0."),
        (6, TEMPLATES["gpl-2.0"]),
        (7, TEMPLATES["lgpl-3.0"]),
        (8, "That code is licensed under the GNU General Public License, version 3."),
        (9, "Released under the ABC License. All lefts reserved."),
    ]
    assert {(i, t) for i, t, _, _ in found(spark, rows)} == {(1, "gpl-2.0-notice"), (3, "cc-by-sa-4.0"), (4, "cc-by-nc-4.0-notice"), (5, "cc-by-4.0-notice"), (6, "gpl-2.0"), (7, "lgpl-3.0"), (8, "gpl-3.0-notice")}


def test_repeated_notices_stay_apart(spark):
    rows = [(1, "All rights reserved. " * 3), (2, TEMPLATES["mit"] + TEMPLATES["mit"]), (3, "Released under the MIT License. " * 400)]
    n = len(licenses.words(TEMPLATES["mit"]))
    want = {(1, "all-rights-reserved", i, i + 2) for i in (0, 3, 6)} | {(2, "mit", 0, n - 1), (2, "mit", n, 2 * n - 1)} | {(3, "mit-notice", i, i + 4) for i in range(0, 2000, 5)}
    assert found(spark, rows) == want


def test_changed_words_and_places(spark):
    mit = " ".join(licenses.words(TEMPLATES["mit"]))
    w = mit.split()
    rows = [
        (1, "foo bar " + mit),
        (2, " ".join(w[:20] + ["extra", "words"] + w[20:])),
        (3, " ".join(w[:30] + w[32:])),
        (4, "RELEASED under,the  MIT-license! text text Released under the MIT License."),
        (5, "the software is great and the license is long"),
        (6, " ".join(w[10:40])),
        (7, " ".join(w[:50] + ["one", "two", "three"] + w[53:])),
    ]
    got = found(spark, rows)
    assert (1, "mit", 2, 1 + len(w)) in got and (2, "mit", 0, len(w) + 1) in got and (3, "mit", 0, len(w) - 3) in got and (7, "mit", 0, len(w) - 1) in got
    assert {(4, "mit-notice", 0, 4), (4, "mit-notice", 7, 11)} <= got
    assert not any(g[0] == 5 for g in got) and (6, "mit", 0, 29) in got
    assert got == independent(rows, TEMPLATES)


@pytest.mark.parametrize("seed", range(3))
def test_scattered_templates_match_the_independent_finder(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(25):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [f"word{rng.randint(0, 999)}" for _ in range(rng.randint(15, 40))]
            t = licenses.words(TEMPLATES[rng.choice(list(TEMPLATES))])
            if len(t) > 40 and rng.random() < 0.6:
                at = rng.randrange(10, len(t) - 10)
                t = t[:at] + [f"put{at}"] * rng.randint(0, 3) + t[at + rng.randint(0, 3) :]
            w += t
        rows.append((i, " ".join(w)))
    assert found(spark, rows) == independent(rows, TEMPLATES)


def test_edge_cases(spark):
    notice = TEMPLATES["mit-notice"]
    rows = [(1, None), (2, ""), (3, "mit"), (None, notice), (5, notice), (5, notice), (5, "so " + notice), (6, "word " * 60_000 + notice)]
    got = licenses.scan(make(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.first_word) for r in got) == [("5", 0), ("5", 1), ("6", 60_000), ("None", 0)]
    assert licenses.scan(make(spark, [])).count() == 0
    assert found(spark, [(1, "two words here")], templates={"x": "two words"}) == set()
    assert found(spark, [(1, "two words here")], templates={}) == set()
