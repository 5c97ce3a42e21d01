import hashlib
from collections import Counter

import corpus_pipeline
import pytest

from tessella.llm import queries


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_shrink(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    sizes = [d.count() for d in stages[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    for a, b in zip(stages, stages[1:-1]):
        assert b.join(a.select("doc_id"), "doc_id", "left_anti").isEmpty()


def test_quality_keeps_clean_labelled_documents(spark, sf, stages):
    marks = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    clean = [i for i, m in marks.items() if m.quality == 1 and m.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_one_of_each_text_stays(stages):
    before = Counter(r.text for r in stages[1].collect())
    after = Counter(r.text for r in stages[2].collect())
    assert after == Counter(dict.fromkeys(before, 1))


def test_all_tokens_are_packed(stages):
    words = sum(len((r.text or "").split()) for r in stages[4].collect())
    assert stages[5].agg({"n_tokens": "sum"}).first()[0] == words


def test_run_equals_stages(spark, sf, stages):
    key = lambda df: Counter((r.doc_id, r.piece, r.n_tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


# the stages again in plain Python


def plain_mix(docs):
    """Budgets in proportion to tokens ** 0.7, the scarcest source whole, with at most 1 % of tokens overlooked and at least 75 % kept."""
    from test_mix_pack import mixed

    total = Counter()
    for _, t, s in docs:
        total[s] += len((t or "").split())
    live = sorted((n for n in total.values() if n), key=lambda n: n**0.3)
    everything, scale, seen = sum(live), None, 0
    for k, n in enumerate(live):
        if scale is None and seen + n > 0.01 * everything:
            scale = n**0.3
        seen += n
    for k in range(len(live)):
        scale = max(scale, (0.75 * everything - sum(live[:k])) / sum(n**0.7 for n in live[k:]))
    out = []
    for s, n in total.items():
        # with one source and its budget as weight, ``mixed`` keeps the hashes within the budget
        mine = [d for d in docs if d[2] == s]
        budget = min(n, int(n**0.7 * scale + 1e-6)) if n else 0
        out += mixed(mine, {s: 1}) if budget >= n else within(mine, budget)
    return out


def within(docs, budget):
    key = lambda d: int(hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16)
    out, used = [], 0
    for k in sorted({key(d) for d in docs}):
        tie = [d for d in docs if key(d) == k]
        used += sum(len((d[1] or "").split()) for d in tie)
        if used > budget:
            break
        out += tie
    return out


def plain_stages(docs, labels):
    """doc_ids after every stage, and the sizes packed: dense classifier, dict, brute-force pairs, sorted hashes."""
    from test_dedup import brute_all
    from test_quality import plain_features, plain_margin, plain_model

    ids, texts = {d[0] for d in docs if d[0] is not None}, {}
    for i, t, _ in docs:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    marks = {}
    for i, q, x in labels:
        if i in ids and i in texts:
            a = marks.get(i, (q, x))
            marks[i] = (min(a[0], q), max(a[1], x))
    order = sorted(marks)
    models = [plain_model([texts[i] for i in order], [marks[i][k] for i in order]) if len({marks[i][k] for i in order}) > 1 else None for k in (0, 1)]
    margin = lambda m, t: plain_margin(m, t) if m else 0.0
    good = [d for d in docs if d[1] and plain_features(d[1]) - set(range(9)) and margin(models[0], d[1]) >= 0 and margin(models[1], d[1]) <= 0]
    first = {}
    for d in sorted(good, key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(d[1], d)
    once = list(first.values())
    near = [(d[0], d[1]) for d in once]
    leader = {d[0]: d[0] for d in once if d[0] is not None}

    def root(x):
        while leader[x] != x:
            x = leader[x]
        return x

    assert len(leader) == sum(d[0] is not None for d in once)  # of these rows no id has two texts left
    for a, b, _ in brute_all(near):
        a, b = sorted((root(a), root(b)))
        leader[b] = a
    apart = [d for d in once if d[0] is None or root(d[0]) == d[0]]
    return good, once, apart, plain_mix(apart)


def run_stages(spark, docs, sf, tmp):
    out = []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf).write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
        out.append(docs)
    return out


def test_pipeline_matches_plain_python(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = plain_stages(rows, labels)
    got = run_stages(spark, docs, sf, tmp_path)
    for w, g in zip(want, got):
        assert sorted(d[0] for d in w) == sorted(r.doc_id for r in g.collect())
    pieces = sorted((d[0], p // 2048, min(2048, n - p)) for d in want[-1] for n in [len(d[1].split())] for p in range(0, n, 2048))
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got[-1].collect()) == pieces
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == pieces


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with nulls, repeated ids and rows, long and empty texts and clashing names, and labels for some."""
    good = lambda k: " ".join(f"word{k}x{i}" for i in range(60)) + " alpha beta gamma."
    rows = [(i, good(i), "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(100 + i, "bad | bad | bad | " * 10 + str(i), "en", "s0", 5) for i in range(12)]
    rows += [(None, good(1000), None, None, None), (200, None, "en", "s1", 0), (201, "", "en", "s1", 0), (202, "!!", "en", "s1", 2), (0, good(0), "en", "s0", 10), (0, good(77), "en", "s0", 10)]
    rows += [(300, "long alpha words " * 40_000, "en", "s2", 1), (301, good(5), "en", "s1", 10), (302, good(6) + " more", "en", "s1", 10)]
    docs = spark.createDataFrame([(*r, "n", 7, "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `__h` int, `_metadata` string")
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(30)] + [(100 + i, 0, 0, "x") for i in range(12)] + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_go_through_every_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = run_stages(spark, docs, odd, f"{odd}/stages")
    assert all(d.columns == docs.columns for d in out[:-1])
    kept = Counter(r.doc_id for r in out[2].collect())
    # the copies 301 and 302 and the repeated row of 0 are gone, its other text and the row without an id are there
    assert kept[0] == 2 and kept[None] == 1 and kept[5] == kept[6] == 1 and not kept[301] and not kept[302]
    assert not any(kept[100 + i] for i in range(12)) and kept[300] == 1
    assert {r.doc_id for r in out[-1].collect()} <= set(kept)


def test_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs.where("false").write.parquet(f"{odd}/none/documents.parquet")
    spark.read.parquet(f"{odd}/labels.parquet").where("false").write.parquet(f"{odd}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{odd}/none").count() == 0
