"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{base}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return None if v is None else str(v)


def rows_of(df, cols):
    return sorted(str([norm(v) for v in r]) for r in df.select(*cols).collect())


def check(query, sql, spark, base) -> int:
    df = query(spark, base)
    cols = sorted(df.columns)
    got = connect(base).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str([norm(r[i]) for i in at]) for r in got.fetchall())
    have = rows_of(df, cols)
    assert have == want
    return len(have)
