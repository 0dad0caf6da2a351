"""Every query of the engine that has SQL gives the same rows as DuckDB on the smallest driver tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from factweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if isinstance(value, (dt.date, dt.datetime)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)

