"""Queries against their SQL on the smallest tables, and what their plans may hold."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest

import tabwright.queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = tabwright.queries.QUERIES, tabwright.queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str(list(x))
        if x is None or pd.isna(x):
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["groupby_stats", "groupby_first_last_concat", "join_full", "dedup_most_complete", "compare_keyed", "profile_column", "semantic_scan", "pii_scan", "cluster_fingerprint", "outlier_mad", "fill_forward", "interpolate"])
def test_plans_are_native(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|CartesianProduct", plan)
