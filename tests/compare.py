"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(data_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = set(mine), set(theirs)
    return [f"rows {len(mine)} and {len(theirs)}"] * (len(mine) != len(theirs)) + [f"- {x}" for x in sorted(a - b)[:3]] + [f"+ {x}" for x in sorted(b - a)[:3]]
