"""Rows of a Spark query and of DuckDB SQL over the same tables, made comparable."""

import glob
import os

import duckdb
import numpy as np


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    if x is None or str(x) in ("NaT", "<NA>", "nan"):
        return "null"
    return f"{x:.9g}" if isinstance(x, (float, np.floating)) else str(x)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(f"{float(x):.9g}" if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)) and x == x else cell(x) for x in r))
    return sorted(out)


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def assert_same(df, con, sql):
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
