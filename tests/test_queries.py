"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from loomframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()) == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0
