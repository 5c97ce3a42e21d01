import math

import numpy as np

from tessella.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, x string"


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return {i: [ids[j] for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}


def recall(got, want):
    return np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def test_recall_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 10)
    got = collect(ann.neighbours(df))
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.95


def test_recall_over_many_cells(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "SUB", 8)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 10)
    assert recall(collect(ann.neighbours(df)), want) >= 0.9


def test_error_bound_holds():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((50, 64))
    x, q = ((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) for v in (x, q))
    c = x.mean(axis=0)
    turn = ann.rotation(64)
    about, error = ann.estimate(*ann.encode(x, c, turn), q, x @ c, c, turn)
    miss = np.abs(about - q @ x.T) > error
    # errors are nearly normal: as many are past the bound as of a normal variable past EPSILON deviations
    assert miss.mean() < math.erfc(ann.EPSILON / math.sqrt(2)) + 0.01 and np.abs(np.mean(about - q @ x.T)) < 0.01


def test_edge_cases(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 0.0]]
    rows = [(i, x) for i, x in enumerate(v)] + [(0, v[0]), (10, None), (11, []), (12, [0.0, 0.0]), (13, [1.0, None]), (14, [1.0]), (None, [1.0, 1.0]), (15, [float("nan"), 1.0])]
    df = spark.createDataFrame([(i, x, 1, 2, "x") for i, x in rows], SCHEMA)
    got = collect(ann.neighbours(df, k=2))
    assert got == {0: [3, 1], 1: [0, 3], 2: [1, 0], 3: [0, 1]}
    assert ann.neighbours(df.where("false")).count() == 0
    assert ann.neighbours(df.where("vec_id = 2")).count() == 0


def store_of(ids, x, sub, turn):
    c, _ = ann._means(x, sub, sub.max() + 1)
    return ann.Store(ids, x, sub, *ann.encode(x, c[sub], turn), turn)


def test_small_cells_give_k_rows():
    turn = ann.rotation(64)
    for seed in range(150):
        rng = np.random.default_rng(seed)
        x = ann._unit(rng.standard_normal((12 + seed % 29, 64)))
        ids = np.arange(len(x))
        store = store_of(ids, x, ids % 3, turn)
        bar, some = store.some(x, ids, 10)
        i, _, _ = store.search(x, ids, bar, np.full(len(x), -np.inf), 10, some)
        assert (np.bincount(i, minlength=len(x)) == 10).all()


def test_search_is_exact_without_error_bound_and_threshold(monkeypatch):
    monkeypatch.setattr(ann, "EPSILON", 1e3)
    x = ann._unit(np.random.default_rng(5).standard_normal((700, 32)))
    ids, turn = np.arange(700) * 3 + 1, ann.rotation(32)
    store = store_of(ids, x, np.random.default_rng(6).integers(0, 9, 700), turn)
    bar, some = store.some(x, ids, 10)
    i, j, s = store.search(x, ids, bar, np.full(700, -np.inf), 10, some)
    want = exact(ids, x.astype(float), 10)
    j = store.ids[j]
    assert all(j[i == r].tolist() == want[ids[r]] for r in range(700))
    assert np.abs(s - np.einsum("ij,ij->i", x[i].astype(float), x[(j - 1) // 3].astype(float))).max() < 1e-12


def test_queries_of_sparse_cells_visit_more():
    q = ann.Quantiser(np.eye(4, dtype=np.float32), 4)
    q.c = np.eye(4, dtype=np.float32)
    x = np.array([[1, 0.5, 0.2, 0.1], [0.1, 0.2, 0.5, 1]], np.float32)
    few, own = np.array([True, False]), np.array([0, 3])
    go = lambda held, visits, k, few=few: sorted(zip(*(a.tolist() for a in ann._targets(x, own, few, q, np.array(held), visits, k))))
    assert go([3, 4, 5, 50], 1, 10) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    assert go([3, 4, 5, 50], 1, 6) == [(0, 0), (0, 1), (1, 3)]
    assert go([1, 0, 0, 1], 2, 10, np.array([True, True])) == [(r, k) for r in (0, 1) for k in range(4)]


def test_many_centres_are_found_through_groups(monkeypatch):
    x = ann._unit(np.random.default_rng(0).standard_normal((4000, 16)))
    flat = ann.Quantiser(x, 100)
    monkeypatch.setattr(ann, "FLAT", 50)
    grouped = ann.Quantiser(x, 100)
    assert grouped.tops is not None and abs(len(grouped.c) - 100) <= 10
    best = np.argsort(-(x @ grouped.c.T), axis=1, kind="stable")
    assert (grouped.near(x, len(grouped.c)) == best).all()
    assert np.mean(grouped.near(x, 1)[:, 0] == best[:, 0]) > 0.75
    assert (flat.near(x, 3) == np.argsort(-(x @ flat.c.T), axis=1, kind="stable")[:, :3]).all()


def test_recall_with_grouped_centres_split_cells_and_slices(spark, sf, monkeypatch):
    for name, n in (("CELL", 8), ("SUB", 4), ("FLAT", 8), ("SLICE", 10)):
        monkeypatch.setattr(ann, name, n)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 10)
    got = collect(ann.neighbours(df))
    assert all(len(got[i]) == 10 and len(set(got[i])) == 10 for i in want) and recall(got, want) >= 0.9


def test_infinite_and_extreme_components(spark):
    v = [[1.0, 0.0], [1e30, 1e29], [0.0, 1e-30], [float("inf"), 1.0], [1.0, float("-inf")], [float("nan"), 0.0]]
    df = spark.createDataFrame([(i, x, 1, 2, "x") for i, x in enumerate(v)], SCHEMA)
    assert collect(ann.neighbours(df, k=2)) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_a_thousand_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, 2, "x") for i in range(1000)] + [(5000, [3.0, 2.0, 1.0], 1, 2, "x")]
    got = collect(ann.neighbours(spark.createDataFrame(rows, SCHEMA), k=3))
    assert got[0] == [1, 2, 3] and got[500] == [0, 1, 2] and got[5000] == [0, 1, 2]
