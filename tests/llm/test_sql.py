"""Queries of the training-data subpackage against their SQL in DuckDB."""

import os

import duckdb
import pytest

from corpusq.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{p}'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    """Every document, where SQL has no form; contents are held against brute force elsewhere."""
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = QUERIES[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == n and (name == "op12_packing" or rows.count() == n)
