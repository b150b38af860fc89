"""Every query with SQL, row by row against DuckDB, over whole tables at TEST_QUERY_DIR (sf0.01)."""

import os

import duckdb
import pytest

from tests.conftest import TABLES
from tests.rows import of_duck, of_spark
from trellis.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.01")


#: queries that ask for what no row can be
EMPTY = {"where_in_empty"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    want = of_duck(duck, ORACLE_SQL[name])
    assert of_spark(QUERIES[name](spark, DIR)) == want
    assert want[1] or name in EMPTY


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
