"""Rows of a query in Spark against rows of its SQL in DuckDB."""

from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    other = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    place = [other.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[k]) for k in place)) for r in other.fetchall())
    assert mine == theirs
