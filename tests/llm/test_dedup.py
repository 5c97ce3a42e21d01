import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, near_dedup, queries
from tessella.llm.near_dedup import RADIUS, RATIO

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__fp` string, h int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
    if n > 10:
        x[5] = x[4]
        x[0] = 0
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(x)) == x).all()


def test_golomb_is_small():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 10_000).astype(np.uint64))
    assert len(exact_dedup.golomb_encode(x)) < 0.6 * 8 * len(x)


ROWS = [(5, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (7, ""), (8, ""), (9, None), (10, None), (11, "x " * 60_000), (12, "x " * 60_000), (13, "solo")]


def test_exact_pairs_edge_cases(spark):
    got = sorted(map(tuple, exact_dedup.duplicate_pairs(make(spark, ROWS)).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (None, 3), (8, 7), (12, 11)], key=str)


def test_exact_drop_keeps_columns_and_nulls(spark):
    docs = make(spark, ROWS)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text and r.text[:5]) for r in got.collect()) == [(3, "a b"), (7, ""), (9, None), (10, None), (11, "x x x"), (13, "solo")]


def test_exact_empty(spark):
    assert exact_dedup.duplicate_pairs(make(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(make(spark, [])).count() == 0


def test_exact_matches_group_by(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert exact_dedup.drop_duplicates(docs).count() == docs.select("text").distinct().count()


def brute(docs, radius=RADIUS, ratio=RATIO):
    d = near_dedup._Digests()
    prints = {i: near_dedup.simhash(t, d) for i, t in docs if i is not None and t is not None}
    prints = {i: p for i, p in prints.items() if p[0]}
    leader = {}
    for i in sorted(prints):
        leader.setdefault(prints[i], i)
    out = {(leader[p], i, 0) for i, p in prints.items() if leader[p] != i}
    reps = sorted(leader.values())
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            (n, p, q), (m, r, s) = prints[a], prints[b]
            far = ((p ^ r) & (2**64 - 1)).bit_count() + ((q ^ s) & (2**64 - 1)).bit_count()
            if far <= radius and min(n, m) >= ratio * max(n, m):
                out.add((a, b, far))
    return out


def test_near_pairs_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in near_dedup.near_pairs(docs).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want and len(got) == near_dedup.near_pairs(docs).count()


@pytest.mark.parametrize("radius,shards", [(6, 16), (20, 7), (40, 12)])
def test_tree_finds_all_pairs(spark, radius, shards):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, (60, 2), dtype=np.int64)
    rows = []
    for i in range(900):
        f = base[i % 60].copy()
        for bit in rng.integers(0, 128, rng.integers(0, 14)):
            f[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64)) if bit % 64 < 63 else np.int64(-(2**63))
        rows.append((i, i, int(rng.integers(40, 120)), int(f[0]), int(f[1])))
    prints = spark.createDataFrame(rows, "doc_id long, h long, n int, f0 long, f1 long")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    got = sorted((r.doc_a, r.doc_b) for r in near_dedup.pairs_of(prints, radius).where("distance > 0").collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    first = {}
    for r in rows:
        first.setdefault(r[2:], r[0])
    want, reps = [], sorted((i, *p) for p, i in first.items())
    for x, (i, n, p, q) in enumerate(reps):
        for j, m, r, s in reps[x + 1 :]:
            far = ((p ^ r) & (2**64 - 1)).bit_count() + ((q ^ s) & (2**64 - 1)).bit_count()
            if 0 < far <= radius and min(n, m) >= RATIO * max(n, m):
                want.append((i, j))
    assert got == sorted(want)


def random_prints(count, seed=5):
    """Fingerprints of which many are few bits apart, across all word counts."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, (count // 3, 2), dtype=np.int64)
    f = base[rng.integers(0, len(base), count)]
    for _ in range(16):
        at = np.flatnonzero(rng.random(count) < 0.5)
        f[at, rng.integers(0, 2, len(at))] ^= np.int64(1) << rng.integers(0, 62, len(at))
    return rng.integers(60, 100, count).astype(np.int32), f[:, 0].copy(), f[:, 1].copy()


@pytest.mark.parametrize("radius,dense,blocks", [(24, 1e5, 12), (24, 1e4, 10), (20, 1e3, 8), (8, 1e5, 9), (24, 1e9, 1), (60, 1e5, 1)])
def test_blocks_of_bits_lose_no_pair(monkeypatch, radius, dense, blocks):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    n, f0, f1 = random_prints(900)
    home = np.random.default_rng(6).random(900) < 0.7
    assert len(near_dedup._blocks(radius, home.sum() * (900 - home.sum() / 2))) == blocks
    got = [(*sorted((int(x), int(y))), int(z)) for i, j, d in near_dedup._near(n, f0, f1, home, radius, RATIO) for x, y, z in zip(i, j, d)]
    far = near_dedup.hamming(f0[:, None], f1[:, None], f0[None], f1[None])
    ok = (far <= radius) & (np.minimum(n[:, None], n) >= RATIO * np.maximum(n[:, None], n) - 1e-9) & (home[:, None] | home)
    assert sorted(got) == [(i, j, int(far[i, j])) for i, j in np.argwhere(ok).tolist() if i < j] and got


def test_shards_do_not_follow_the_shuffle():
    """As rows visit a share of all shards, a shard for each of 600 partitions sent every row of 6 GB to some 40 of them."""
    assert near_dedup.shards_for(2_800_000, 600, 6) == 24
    assert near_dedup.shards_for(28_000_000, 6000, 6) == 140
    assert near_dedup.shards_for(9_000, 600, 6) == near_dedup.shards_for(0, 600, 6) == 1


def test_a_shard_gives_no_more_rows_than_it_has(monkeypatch):
    """Of a group of near copies come its rows, not its pairs, however many pairs are held at once."""
    monkeypatch.setattr(near_dedup, "HELD", 500)
    n, f0, f1 = (x.repeat(40) for x in random_prints(30))
    texts = np.arange(len(n)) % 3 + 1
    home = np.arange(len(n)) % 4 > 0
    ids = np.arange(len(n))
    got = near_dedup._gather(RADIUS, RATIO)(pa.table({"doc_id": ids, "h": ids, "n": n, "f0": f0, "f1": f1, "texts": texts, "home": home})).to_pydict()
    far = near_dedup.hamming(f0[:, None], f1[:, None], f0[None], f1[None])
    near = (far <= RADIUS) & (np.minimum(n[:, None], n) >= RATIO * np.maximum(n[:, None], n) - 1e-9) & (home[:, None] | home) & (ids[:, None] != ids)
    assert got["links"] == near.dot(texts).tolist() and near.sum() / 2 > 20 * len(ids) > 20 * len(got["to_id"]) - 1
    lead = ids.copy()
    while (lead != (new := np.minimum(lead, np.where(near, lead, len(ids)).min(1)))).any():
        lead = new
    assert got["to_id"] == lead.tolist()


@pytest.mark.parametrize("size", [40, 150])
def test_classes_over_several_shards(spark, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "LEAST_SHARD", size)
    n, f0, f1 = random_prints(600, size)
    prints = spark.createDataFrame([(i // 2, i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(n, f0, f1))], "doc_id long, h long, n int, f0 long, f1 long")
    got = {(r.doc_id, r.h): (r.class_id, r.class_h, r.links) for r in near_dedup.classes_of(prints).collect()}
    far = near_dedup.hamming(f0[:, None], f1[:, None], f0[None], f1[None])
    near = (far <= RADIUS) & (np.minimum(n[:, None], n) >= RATIO * np.maximum(n[:, None], n) - 1e-9)
    lead = np.arange(600)
    while (lead != (new := np.where(near, lead, 600).min(1))).any():
        lead = new
    assert got == {(i // 2, i): (lead[i] // 2, lead[i], near[i].sum() - 1) for i in range(600)}


def test_near_edge_cases(spark):
    words = " ".join(f"word{i}" for i in range(200))
    rows = [(1, words), (2, words + " more"), (2, words + " more"), (3, None), (4, ""), (5, "!!"), (None, words), (6, " ".join(f"other{i}" for i in range(200))), (7, "x " * 60_000)]
    docs = make(spark, rows)
    assert [(r.doc_a, r.doc_b) for r in near_dedup.near_pairs(docs).collect()] == [(1, 2)]
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    twice = near_dedup.drop_near_duplicates(make(spark, [(2, words), (2, words), (3, "a b c d"), (4, None), (4, None)]))
    assert sorted(r.doc_id for r in twice.collect()) == [2, 3, 4, 4]
    assert near_dedup.near_pairs(make(spark, [])).count() == 0
    assert near_dedup.drop_near_duplicates(make(spark, [])).count() == 0


def brute_all(docs):
    d = near_dedup._Digests()
    prints = [(i, near_dedup.simhash(t, d)) for i, t in sorted({(i, t) for i, t in docs if i is not None and t is not None})]
    prints = [(i, p) for i, p in prints if p[0]]
    out = []
    for x, (a, (n, p, q)) in enumerate(prints):
        for b, (m, r, s) in prints[x + 1 :]:
            far = ((p ^ r) & (2**64 - 1)).bit_count() + ((q ^ s) & (2**64 - 1)).bit_count()
            if far <= RADIUS and min(n, m) >= RATIO * max(n, m):
                out.append((a, b, far))
    return sorted(out)


@pytest.mark.parametrize("most", [3, 256])
def test_all_pairs_of_copies_and_their_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "LIST", most)
    words = " ".join(f"word{i}" for i in range(200))
    rows = [(i, words) for i in range(0, 40, 2)] + [(i, words + " more") for i in range(1, 20, 2)] + [(100, "solo here"), (4, words), (None, words), (50, None), (51, "!!")]
    got = sorted(map(tuple, near_dedup.all_pairs(make(spark, rows)).collect()))
    assert got == brute_all(rows) and len(got) == 30 * 29 // 2
    assert near_dedup.all_pairs(make(spark, [])).count() == 0


def plain_classes(docs):
    """(id, text): (the least document of its class, links), from all pairs; a document is known by its place."""
    have = sorted({(i, t) for i, t in docs if i is not None}, key=lambda d: (d[0], d[1] is not None, d[1] or ""))
    lead, links = list(range(len(have))), [0] * len(have)
    pairs = [(a, b) for a, b, _ in brute_all([(k, t) for k, (_, t) in enumerate(have)])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if lead[a] != lead[b]:
                lead[a] = lead[b] = min(lead[a], lead[b])
                moved = True
    return {d: (have[lead[k]][0], links[k]) for k, d in enumerate(have)}


def test_query_gives_a_row_for_each_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op1_simhash_near_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == sorted((i, *x) for (i, _), x in want.items())
    assert sum(r.links for r in got) == 2 * near_dedup.all_pairs(docs).count() > 0


def test_classes_of_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(200))
    rows = [(i, words) for i in range(10, 40, 2)] + [(i, words + " more") for i in range(11, 20, 2)]
    rows += [(12, words), (None, words), (50, None), (51, "!!"), (52, "!!"), (53, ""), (53, ""), (10, other(1)), (60, other(1) + " more"), (61, other(1)), (62, other(2))]
    docs = make(spark, rows)
    got = near_dedup.classes(docs).collect()
    want = plain_classes(rows)
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == sorted((i, *x) for (i, _), x in want.items())
    # the two texts of 10 lead a class each
    assert {(r.class_id, r.class_text_hash) for r in got if r.doc_id in (38, 61)} == {(r.doc_id, r.text_hash) for r in got if r.doc_id == 10}
    assert [r.text_hash for r in got if r.doc_id == 50] == [None] and len({r.text_hash for r in got if r.doc_id in (51, 52)}) == 1
    assert near_dedup.classes(make(spark, [])).count() == 0


def test_rows_of_a_large_group_follow_its_size(spark, tmp_path):
    """A group of 300 gave 44,850 rows when pairs were listed."""
    make(spark, [(i, other(0) + (" more" if i % 3 else "")) for i in range(300)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == 300 and {(r.class_id, r.links) for r in got} == {(0, 299)}


def test_radius_catches_most_copies_with_a_tenth_replaced():
    rng, d, lost = np.random.default_rng(3), near_dedup._Digests(), 0
    for i in range(400):
        w = [f"w{i}x{j}" for j in range(20)]
        a = near_dedup.simhash(" ".join(w), d)
        for j in rng.choice(20, 2, replace=False):
            w[j] = f"new{i}x{j}"
        b = near_dedup.simhash(" ".join(w), d)
        lost += ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() + ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() > RADIUS
    assert lost <= 0.12 * 400


def test_groups_follow_long_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "doc_a long, doc_b long")
    got = {r.doc: r.leader for r in near_dedup.groups_of(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def other(k, n=200):
    return " ".join(f"t{k}w{i}" for i in range(n))


def test_an_id_of_several_texts_loses_only_near_copies(spark):
    a = other(0)
    rows = [(1, a), (2, a + " more"), (2, other(1)), (3, other(2)), (2, other(2) + " more"), (4, other(3)), (4, other(3) + " more")]
    docs = make(spark, rows)
    left = sorted((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect())
    # 2's copy of 3 leads its group, as its id is the least; 4's two texts are one group
    assert sorted(i for i, _ in left) == [1, 2, 2, 4]
    assert (2, other(1)) in left and (2, other(2) + " more") in left and (1, a) in left
    assert sorted((r.doc_a, r.doc_b) for r in near_dedup.all_pairs(docs).collect()) == [(1, 2), (2, 3)]
    assert sorted((r.doc_a, r.doc_b) for r in near_dedup.near_pairs(docs).collect()) == [(1, 2), (2, 3), (4, 4)]


def test_ids_shared_by_unrelated_texts_do_not_join_groups(spark):
    """Every text stands twice, in copies whose ids all clash with those of other texts."""
    rows = [(i % 5, other(i)) for i in range(20)] + [((i + 1) % 5, other(i) + " more") for i in range(20)]
    assert near_dedup.drop_near_duplicates(make(spark, rows)).count() == 20


NAMES = "doc_id long, text string, `a.b` string, `_metadata` string, `__id` int, `c``d` int"


def test_any_column_names(spark):
    rows = [(1, other(0), "x", "m", 1, 2), (2, other(0) + " more", "y", "n", 3, 4), (3, other(0), "x", "m", 1, 2), (3, other(0), "z", "m", 1, 2)]
    docs = spark.createDataFrame(rows, NAMES)
    near = near_dedup.drop_near_duplicates(docs)
    assert near.columns == docs.columns and [tuple(r) for r in near.collect()] == rows[:1]
    once = near_dedup.drop_near_duplicates(docs.where("doc_id = 3"))
    assert once.columns == docs.columns and once.count() == 1
    exact = exact_dedup.drop_duplicates(docs)
    assert exact.columns == docs.columns and sorted(tuple(r) for r in exact.collect()) == rows[:2]
    assert [tuple(r) for r in exact_dedup.duplicate_pairs(docs).collect()] == [(3, 1), (3, 1)]


def test_a_column_called_metadata_of_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "m"), (2, "a", "n"), (3, "b", "o")], "doc_id long, text string, `_metadata` string")
    docs.write.parquet(f"{tmp_path}/docs")
    got = exact_dedup.drop_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "m"), (3, "b", "o")]
