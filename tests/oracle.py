"""Compares a Spark result with DuckDB's over the same files, as multisets of rows with floats rounded to six places."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(df, con, sql: str) -> None:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, expected.fetchall())
