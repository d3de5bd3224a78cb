"""Every registered query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


def plain(v):
    return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(names, data):
        at = [list(names).index(c) for c in columns]
        return sorted(str([plain(r[k]) for k in at]) for r in data)

    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 7
