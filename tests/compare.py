"""Comparing a query's rows with those of SQL."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ in ("datetime", "Timestamp", "date"):
        return str(v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(sql, folder=DATA):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    r = c.sql(sql)
    names = [d[0] for d in r.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
