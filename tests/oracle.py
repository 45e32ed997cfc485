"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def agree(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    answer = con.sql(sql)
    assert sorted(answer.columns) == names
    at = [answer.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in answer.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
