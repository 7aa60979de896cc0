"""Compares a query with its oracle statement on the same tables."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(bytes(v)) if isinstance(v, (bytes, bytearray)) else repr(v)


def same(df, connection, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = connection.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
