"""Every registered query against its SQL, and what its physical plan must not contain."""
import duckdb
import pytest

import __spark_entry__ as registered
from conftest import SF

QUERIES = {name: query for name, query in registered.queries().items() if name in registered.QUERIES}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 44


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "CollectLimit"):
        assert operator not in plan, (name, operator)


def test_entry(spark):
    assert registered.entry(spark).count() == 77


def test_anchors_of_the_mapping(ws):
    """Counts published with the mapping for this scale."""
    assert ws.sessions.count() == 401
    flags = ["f_view_item", "f_add_to_cart", "f_checkout", "f_shipping", "f_payment", "f_purchase", "has_purchase"]
    assert [ws.sessions.where(f).count() for f in flags] == [298, 172, 102, 102, 56, 38, 42]
    assert ws.sessions.where("has_purchase AND NOT has_begin_checkout").count() == 1
    assert [ws.sessions.where(c).count() for c in ("n_session_start = 0", "n_session_start > 1", "device_category IS NULL")] == [5, 2, 24]
