import numpy as np
from pyspark.sql import functions as F

from tessella.llm import url_filter

SCHEMA = "page_id long, url string, html string, names string, rule string"


def make(spark, urls):
    return spark.createDataFrame([(i, u, "h", "n", "r") for i, u in enumerate(urls)], SCHEMA)


def rules(spark, values):
    return spark.createDataFrame([(v,) for v in values], "rule string")


URLS = [
    "http://Bad.example.com/a?x=1#f", "https://sub.bad.example.com/", "https://good.org/path/?q=2", "https://good.org/path/", "ftp://u:p@good.org:8080/only",
    None, "", "notaurl", "https://xbad.example.com/", "https://good.org/" + "p" * 100_000, "https://good.org/path/",
]


def test_rules(spark):
    got = {r.page_id: r.rule for r in url_filter.match(make(spark, URLS), rules(spark, ["bad.example.com", "good.org/path", None, "bad.example.com", "good.org/only", "good.org/" + "p" * 100_000])).collect()}
    assert len(got) == len(URLS)
    assert [got[i] for i in range(9)] == ["bad.example.com", "bad.example.com", "good.org/path", "good.org/path", "good.org/only", None, None, None, None]
    assert got[9].startswith("good.org/ppp") and got[10] == "good.org/path"


def test_no_rules_and_no_pages(spark):
    assert {r.blocked for r in url_filter.match(make(spark, URLS), rules(spark, [])).collect()} == {False}
    assert url_filter.match(make(spark, []), rules(spark, ["a"])).count() == 0


def test_collisions_are_told_apart(spark, tmp_path):
    url_filter._put(str(tmp_path), "0.letters", b"onetwothree")
    url_filter._put(str(tmp_path), "0.ends", np.array([3, 6, 11], np.int64).tobytes())
    url_filter._put(str(tmp_path), "0.keys", np.array([5, 5, 9], np.uint64).tobytes())
    d = url_filter.DigestArray(str(tmp_path), 0)
    assert d.find(np.array([5, 5, 5, 9, 7, 99], np.uint64), ["two", "one", "none", "three", "x", "y"]).tolist() == [True, True, False, True, False, False]


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD", 100)
    names = [f"host{i}.example" for i in range(1000)]
    d = url_filter.DigestArray.build(rules(spark, names[::2]), "rule")
    assert d.bits == 3
    keys = np.array([r[0] for r in rules(spark, names).select(F.xxhash64("rule")).collect()], np.int64).astype(np.uint64)
    assert d.find(keys, names).tolist() == [i % 2 == 0 for i in range(1000)]


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "https://bad.example/x", "h"), (1, "https://bad.example/x", "h"), (1, "https://bad.example/x", "h"), (2, None, "h"), (None, "https://ok.example/", "h")]
    pages = spark.createDataFrame([(*r, 1, "k", True, "m") for r in rows], "page_id long, url string, html string, keys int, names string, blocked boolean, `a.b` string")
    got = url_filter.match(pages, rules(spark, ["bad.example"])).collect()
    assert sorted(((r.page_id, r.blocked, r.rule) for r in got), key=str) == sorted([(None, True, "bad.example"), (1, True, "bad.example"), (1, True, "bad.example"), (2, False, None), (None, False, None)], key=str)
