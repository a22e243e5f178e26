"""Runs a registered query on Spark and its SQL on DuckDB, and compares rows and column names."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    """One form for equal values of both engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v) -> str:
    return "number" if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else type(v).__name__


def bag(names: list[str], rows: list) -> tuple[list[str], Counter, dict[str, set]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds = {names[i]: {type(r[i]).__name__ for r in rows if r[i] is not None} for i in order}
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows), kinds


def differences(df, sql: str, con) -> str:
    """Empty if both give the same rows."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = bag(names, rel.fetchall())
    ours = bag(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        more, less = list((ours[1] - theirs[1]).items())[:3], list((theirs[1] - ours[1]).items())[:3]
        return f"{sum(ours[1].values())} rows against {sum(theirs[1].values())}; ours alone {more}; theirs alone {less}"
    wrong = {n: (ours[2][n], theirs[2][n]) for n in ours[0] if ours[2][n] != theirs[2][n]}
    return f"types {wrong}" if wrong else ""
