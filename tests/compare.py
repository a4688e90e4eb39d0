"""Query results against DuckDB on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def counted(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[int, int, list]:
    """(rows here, rows in SQL, some rows only one side has)."""
    rows = [tuple(r) for r in df.collect()]
    told = con.execute(sql)
    columns = [d[0] for d in told.description]
    want = told.fetchall()
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    here, there = counted(df.columns, rows), counted(columns, want)
    return len(rows), len(want), list((here - there).items())[:3] + list((there - here).items())[:3]
