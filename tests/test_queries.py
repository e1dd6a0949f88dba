"""Every registered query against its SQL in DuckDB, on the smallest tables; the others must run and give rows."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  fills the registry
from corpusq.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    names = list(want.columns)
    assert columns == sorted(names)
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "context", "sources", "retrieved"] and df.count() > 0
