"""Every core query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lanternspark import queries as Q


def normal(df):
    df = df[sorted(df.columns)]
    f = lambda x: "~" if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(map(tuple, df.map(f).values.tolist()))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    a, b = Q.QUERIES[name](spark, sf).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0
