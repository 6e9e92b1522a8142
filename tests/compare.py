"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    if hasattr(value, "__float__") and not isinstance(value, (int, bool)):
        return f"{float(value):.6f}"
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_duckdb(connection, sql: str):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)


def types_of_duckdb(connection, sql: str) -> dict[str, str]:
    return {row[0]: row[1] for row in connection.execute(f"describe {sql}").fetchall()}
