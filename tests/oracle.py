"""Compare a query with its SQL on the same tables, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(x + 0.0)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
