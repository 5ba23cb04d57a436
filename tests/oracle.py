"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value) -> str:
    if isinstance(value, (float, Decimal)):
        return repr(round(float(value), 9))
    return repr(value)


def differences(df, sql: str, sf_dir: str) -> list:
    """Rows that only one side has, at most ten."""
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    if got == want:
        return []
    return [("got", r) for r in got if r not in set(want)][:5] + [("want", r) for r in want if r not in set(got)][:5] or [("counts", len(got), len(want))]
