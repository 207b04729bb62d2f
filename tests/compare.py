"""A query's rows against its SQL in DuckDB, order aside."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return repr(v) if isinstance(v, float) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def same(df, sql: str, folder: str) -> None:
    a, b = rows_of(df), sql_rows(sql, folder)
    assert a[0] == b[0]
    assert a[1] == b[1]
