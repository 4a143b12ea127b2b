"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def difference(df, connection, sql: str) -> str | None:
    """What differs, or None."""
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} and {sorted(relation.columns)}"
    ours = rows_of(df.columns, [tuple(row) for row in df.collect()])
    theirs = rows_of(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in theirs][:2] if len(ours) < 20000 else []
        missing = [r for r in theirs if r not in ours][:2] if len(theirs) < 20000 else []
        return f"{len(ours)} rows and {len(theirs)}; only ours {extra}; only theirs {missing}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows, first {wrong[0]}"
    return None
