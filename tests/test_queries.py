"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from wayfarer.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        f = float(v)
        return str(int(f)) if abs(f) < 1e18 and f == int(f) else f"{f:.6g}"
    return str(v).replace(" 00:00:00", "")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(map(shown, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = REGISTRY.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(REGISTRY.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert len(REGISTRY.QUERIES[name](spark, SF).toPandas()) > 0
