"""Run a registered query and its SQL twin and compare rows without order."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf, fn, sql, con):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - t
    if sql is None:
        return secs, len(got), None
    t = time.time()
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return secs, len(got), f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if a == b:
        return secs, len(got), None
    sa, sb = set(a), set(b)
    return secs, len(got), f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"
