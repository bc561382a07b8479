"""Every query that has SQL gives DuckDB's rows; plans of search queries run no Python."""

import os
import re

import duckdb
import pytest

from lodestone import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    found = duck.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in Q.QUERIES if n[:2] in ("k_", "r_", "s_", "f_", "a_", "t_") and n != "s_encode"))
def test_no_python_in_plans(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapInPandas|MapInArrow", plan)


def test_entry_points(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
