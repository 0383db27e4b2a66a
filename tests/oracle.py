"""Comparing a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), [tuple(r[i] for i in order) for r in out.fetchall()]


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(r) for r in df.select(*names).collect()]


def same(a, b):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12)):
                return False
    return True
