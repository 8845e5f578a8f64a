"""Runs a query and its SQL over the same tables and compares all values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(normal(x) for x in v) if isinstance(v, (list, tuple)) else v


def check(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    out = con.execute(sql)
    names, want = [c[0] for c in out.description], out.fetchall()
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    assert columns == sorted(names)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in frame.collect()), key=repr)
    want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in want), key=repr)
    assert got == want
    assert got
