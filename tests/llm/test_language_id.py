import numpy as np
import xxhash
import zstandard

from tessella.llm import language_id

SCHEMA = "doc_id long, text string, lang string, language string"


def test_held_out_accuracy(spark):
    """A few documents hold passages of two languages and can't be told."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dicts = language_id.dictionaries(docs.where("doc_id % 2 = 0"))
    out = language_id.identify(docs.where("doc_id % 2 = 1 and n_chars > 200"), dicts).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    right = np.mean([r.language == lang[r.doc_id] for r in out])
    wrong = np.mean([r.language not in (lang[r.doc_id], language_id.UNKNOWN) for r in out])
    assert right > 0.93 and wrong < 0.03


def test_edge_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dicts = language_id.dictionaries(docs)
    english = docs.where("lang = 'en' and n_chars > 300").first().text
    french = docs.where("lang = 'fr' and n_chars > 300").first().text
    rows = [(1, None), (2, ""), (3, "7"), (4, english), (4, english), (None, english), (5, (english + " ") * 400), (6, "zq" * 2000), (7, english[:300] + french[:300])]
    out = language_id.identify(spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA), dicts).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].language for i in (1, 2, 3)] == ["und"] * 3 and by[1].best_bytes is None
    assert [by[i].language for i in (4, None, 5)] == ["en"] * 3
    none = spark.createDataFrame([(1, "a b c", None, "x")], SCHEMA)
    assert language_id.identify(none).first().language == "und"
    assert language_id.identify(none.where("false")).count() == 0


def spark_hash(x):
    """xxhash64 of a string or a long as Spark has it."""
    raw = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
    return (xxhash.xxh64_intdigest(raw, 42) + 2**63) % 2**64 - 2**63


def plain(rows, margin=language_id.MARGIN):
    """(language, bytes, margin) of every (doc_id, text, lang), with dictionaries from the other half of the texts."""
    content = {}
    for fold in (0, 1):
        for lang in {r[2] for r in rows if r[2]}:
            mine = {(spark_hash(i), i, spark_hash(t), t) for i, t, x in rows if x == lang and t is not None and i is not None and spark_hash(t) % 2 != fold}
            raw, seen = b"", set()
            for _, _, _, t in sorted(mine)[: language_id.SAMPLE]:
                add = t.lower().encode() + b"\n"
                if t not in seen and len(raw) + len(add) <= language_id.DICTIONARY:
                    raw, seen = raw + add, seen | {t}
            if raw:
                content[fold, lang] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    out = []
    for _, t, _ in rows:
        if not t:
            out.append(("und", None, None))
            continue
        raw = t.lower().encode()
        n = max(1, -(-len(raw) // language_id.PIECE))
        cut = -(-len(raw) // n)
        found = []
        for (fold, lang), d in content.items():
            if fold == spark_hash(t) % 2:
                c = zstandard.ZstdCompressor(dict_data=d, level=language_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                found.append((sum(len(c.compress(raw[p : p + cut])) for p in range(0, len(raw), cut)), lang))
        (best, lang), (second, _) = sorted(found)[:2]
        out.append((lang if (second - best) / best >= margin else "und", best, (second - best) / best))
    return out


def test_query_matches_plain_python(spark, sf):
    from tessella.llm import queries

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.language, r.best_bytes, r.margin) for r in queries.op5_language_id(spark, sf).collect()), key=str)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain(rows))), key=str)


def test_equal_sizes_are_no_language(spark):
    dicts = {"aa": b"one two three four", "bb": b"one two three four"}
    out = language_id.identify(spark.createDataFrame([(1, "one two three", None, "x")], SCHEMA), dicts).first()
    assert out.language == "und" and out.margin == 0.0


def test_texts_are_scored_by_dictionaries_without_them(spark):
    rows = [(i, f"{w} {i}", w) for i in range(60) for w in ("alpha beta gamma", "delta epsilon zeta")]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)] + [(900, rows[0][1], rows[0][2])]
    folds = language_id.fold_dictionaries(spark.createDataFrame([(i, t, x, "x") for i, t, x in rows], SCHEMA))
    for _, t, _ in rows:
        assert not any(t.encode() + b"\n" in c for c in folds[spark_hash(t) % 2].values())
        assert any(t.encode() + b"\n" in c for c in folds[1 - spark_hash(t) % 2].values())


def test_dictionaries_hold_whole_texts(spark):
    assert language_id.fitting(["a", "b", "c", "a"], [4, 21, 3, 4], 8) == [0, 2]
    assert language_id.fitting(["a"], [41], 8) == [0] and language_id.fitting([], [], 8) == []
    long = "\u00c9t\u00e9 " * 30
    rows = [(1, "Abc", "x"), (2, long, "x"), (3, "ef", "x"), (4, "Abc", "x"), (5, long, "y")]
    got = language_id.dictionaries(spark.createDataFrame([(i, t, x, "n") for i, t, x in rows], SCHEMA), size=8)
    assert sorted(got["x"].split(b"\n")) == [b"", b"abc", b"ef"] and got["y"] == long.lower().encode() + b"\n"
