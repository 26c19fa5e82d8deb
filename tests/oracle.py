"""Runs a query and its SQL twin on the same tables and compares them."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value + 0.0
    return value


def compare(df, con, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    expected = cursor.fetchall()
    order = sorted(names)
    found = []
    if sorted(df.columns) != order:
        return [f"columns {sorted(df.columns)} != {order}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")

    def rows(data, columns):
        at = [columns.index(name) for name in order]
        return sorted(([plain(row[i]) for i in at] for row in data), key=lambda r: [(v is not None, str(v)) for v in r])

    left, right = rows(df.collect(), df.columns), rows(expected, names)
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        found.append(f"{len(different)} rows differ, first {order}: {str(different[0])[:600]}")
    return found
