"""Every registered query with SQL against DuckDB at the smallest scale; the others only run."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as driver
from keyfold import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list) else bytes(x) if isinstance(x, bytearray) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [n for n in driver.queries() if n in driver.oracle_sql()])
def test_same_as_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(driver.oracle_sql()[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_supplier_sets_are_whole(spark, duck):
    found = duck.execute("SELECT DISTINCT l_suppkey::VARCHAR, l_partkey FROM lineitem").fetchall()
    assert sorted(map(tuple, queries._supplier_parts(spark, SF).select("key", "member").collect())) == sorted(found)


def test_sql_has_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert driver.entry(spark).count() > 0
