"""Rows of a query beside those of its SQL."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def shown(v) -> str:
    if v is None:
        return "None"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def same(spark, query, sql: str, folder: str = FOLDER) -> None:
    base = duckdb.connect()
    for f in os.listdir(folder):
        base.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    frame, found = query(spark, folder), base.sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(found.columns)
    ours = sorted(tuple(map(shown, r)) for r in frame.select(names).collect())
    at = [found.columns.index(n) for n in names]
    theirs = sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs
