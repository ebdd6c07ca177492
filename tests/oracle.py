"""Runs a query in Spark and its SQL in DuckDB and compares rows without order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, bool):
        return str(int(v))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(con, sql: str, columns: list[str]) -> list[tuple]:
    con.execute(f"CREATE OR REPLACE VIEW checked AS {sql}")  # SQL that a view refuses is of no use
    cursor = con.execute("SELECT * FROM checked")
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(tuple(_norm(r[i]) for i in at) for r in cursor.fetchall())
