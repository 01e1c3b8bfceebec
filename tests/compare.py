"""Runs a query beside its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def same(df, sql: str, folder: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    c = database(folder)
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = bag(names, got.fetchall()), bag(df.columns, [tuple(r) for r in df.collect()])
    if want == have:
        return ""
    return f"{sum(have.values())} rows and {sum(want.values())}; only here {list((have - want).items())[:3]}; only in SQL {list((want - have).items())[:3]}"
