"""Queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = duck.execute(SQL[name])
    df = QUERIES[name](spark, SF).select(*[d[0] for d in found.description])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
