import duckdb
import pytest

from conftest import SF
from shoptrail.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def rows():
    """Rows of a given table of the smallest data."""
    return lambda sql: duckdb.connect().execute(sql.replace("@", SF + "/")).fetchall()
