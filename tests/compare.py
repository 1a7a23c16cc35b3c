"""Order-insensitive comparison of a Spark result and its oracle."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from workloads.registry import BASE_TABLES, Workload, oracle_text


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def mismatch(spark, item: Workload, folder: str, connection) -> str | None:
    """What differs, or None."""
    frame = item.run(spark, folder)
    actual_rows = frame.collect()
    relation = connection.execute(oracle_text(item))
    columns = [field[0] for field in relation.description]
    expected_rows = relation.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    actual, expected = _bag(frame.columns, actual_rows), _bag(columns, expected_rows)
    if actual == expected:
        return None
    extra, missing = list((actual - expected).items())[:3], list((expected - actual).items())[:3]
    return f"{len(actual_rows)} rows, expected {len(expected_rows)}; extra {extra}; missing {missing}; {sorted(columns)}"
