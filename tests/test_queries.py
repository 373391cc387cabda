"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from polyquarry import catalog

FOLDER = "/root/testdata/sf0.001"
#: Long loops of small jobs; they run with the rest of the graph tests on tiny graphs.
SLOW = {"graph_closeness", "graph_betweenness_values"}


def one(v):
    if isinstance(v, float):
        return "N" if v != v else repr(round(v, 6) + 0.0)
    return "N" if v is None else str([one(x) for x in v]) if isinstance(v, list) else str(v)


def rows(t):
    names = sorted(t.column_names)
    return names, sorted(tuple(map(one, r)) for r in zip(*(t[c].to_pylist() for c in names), strict=True))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_against_duckdb(spark, tables, name):
    assert rows(catalog.queries()[name](spark, FOLDER).toArrow()) == rows(tables.sql(catalog.oracle_sql()[name]).to_arrow_table())
