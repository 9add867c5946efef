"""Every registered query of the engine's own operators against DuckDB on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    def text(v):
        if pd.isna(v):
            return "none"
        return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_oracles_name_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
