"""Spark result against its SQL counterpart in DuckDB, independent of row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value, ".9g")
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr), [columns[i] for i in order]


def assert_same(df, con, sql):
    got, got_columns = canonical([tuple(r) for r in df.collect()], df.columns)
    answer = con.execute(sql)
    want, want_columns = canonical(answer.fetchall(), [d[0] for d in answer.description])
    assert got_columns == want_columns, (got_columns, want_columns)
    assert len(got) == len(want), (len(got), len(want))
    for mine, theirs in zip(got, want):
        assert mine == theirs, (mine, theirs)
    return len(got)
