"""Runs a registered query and its check SQL on the same files and reports differences."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((v is not None, str(v)) for v in t))


def differences(frame, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns: extra {set(frame.columns) - set(columns)} missing {set(columns) - set(frame.columns)}"
    mine = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = _rows(columns, expected)
    if len(mine) != len(theirs):
        return f"rows: {len(mine)} against {len(theirs)}"
    names = sorted(columns)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if not bad:
        return None
    a, b = bad[0]
    cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
    return f"{len(bad)} of {len(mine)} rows differ, first: {cells[:6]}"
