"""Every query against its SQL in DuckDB, and the rest for rows and schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return v
        if hasattr(v, "__float__") and not isinstance(v, str):
            return round(float(v), 6) + 0.0
        return str(v)

    return sorted((tuple(one(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got) > 0
        return
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
