"""Run a registered query and its SQL counterpart, and compare their rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        if Path(folder, f"{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    rows = Counter(tuple(_cell(v) for v in row) for row in df.select(*columns).collect())
    return columns, rows


def sql_rows(connection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    return sorted(names), rows


def differences(df, connection, sql: str) -> str | None:
    """Nothing when both agree, else a short description of how they differ."""
    left_names, left = spark_rows(df)
    right_names, right = sql_rows(connection, sql)
    if left_names != right_names:
        return f"columns {left_names} and {right_names}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{sum(left.values())} and {sum(right.values())} rows; only Spark {list(only_left)[:2]}, "
            f"only SQL {list(only_right)[:2]}"
        )
    return None
