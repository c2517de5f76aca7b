"""Compare a Spark result with a DuckDB query on the same parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def canonical(columns, rows):
    """Rows with their columns in name order, sorted; null sorts as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None when both sides agree in columns, rows and every value."""
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    if ours != theirs:
        first = next((a, b) for a, b in zip(ours, theirs) if a != b)
        count = sum(a != b for a, b in zip(ours, theirs))
        return f"{count} rows differ, first {first}"
    return None
