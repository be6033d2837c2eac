"""The registered queries against their SQL, and what native ones must not contain."""
import duckdb
import pytest

from conftest import SF
from shoptrail.llm import queries as llm

TABLES = "documents embeddings pages benchmark labels conversations".split()
NATIVE = ("op2_chat_format", "op9_sketch", "op10_url_lists")


@pytest.mark.parametrize("name", list(llm.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    result = con.execute(llm.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = llm.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert operator not in plan, operator


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
