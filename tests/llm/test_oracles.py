"""The operators' queries that have SQL give the same rows as DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from factweave.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, wanted = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=repr)


def test_there_is_a_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in catalog.queries()] == list(range(1, 11))
