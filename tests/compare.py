"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sorted(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return sorted((tuple(_cell(row[at]) for at in order) for row in rows), key=repr)


def differences(spark, con, query, sql: str, folder: str) -> list[str]:
    """Empty when row counts, column names and all values agree."""
    df = query(spark, folder)
    ours = [tuple(row) for row in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    left, right = _sorted(df.columns, ours), _sorted(names, theirs)
    found = [f"rows {len(left)} / {len(right)}"] if len(left) != len(right) else []
    only = [(a, b) for a, b in zip(left, right) if a != b]
    if only:
        found.append(f"{len(only)} of {len(left)} rows differ, first: {only[0]}")
    return found
