"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares names and values."""

from __future__ import annotations

import datetime
import glob
from pathlib import Path

import duckdb


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        files = f"{path}/*.parquet" if Path(path).is_dir() else path
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def table(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == table(names, got.fetchall())
