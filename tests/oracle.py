"""Runs a registered query on Spark and its SQL on DuckDB, and compares rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(connection, sql):
    rel = connection.sql(sql)
    cols, rows = list(rel.columns), rel.fetchall()
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
