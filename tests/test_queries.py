"""Every own query that has SQL gives what DuckDB gives; the others have rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sievegrid.plans.campaign_queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if isinstance(x, bool):
        return str(x)
    if pd.isna(x):
        return "null"
    return f"{float(x) + 0.0:.5f}" if isinstance(x, int | float) else str(x)


def cells(df):
    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    if name not in ORACLE:
        assert got.count() >= 0
        return
    want = con.execute(ORACLE[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
