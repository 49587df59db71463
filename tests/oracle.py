"""Run a catalogue query next to its DuckDB check and compare the values."""

from __future__ import annotations

import datetime as dt
import math
import os
from decimal import Decimal

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, bool):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def _sortable(row):
    return [(v is None, str(type(v).__name__ != "str"), repr(v)) for v in row]


def rows_of_spark(df):
    names = sorted(df.columns)
    rows = [[plain(v) for v in r] for r in df.select(*names).collect()]
    return names, sorted(rows, key=_sortable)


def rows_of_duckdb(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [[plain(r[i]) for i in order] for r in result.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_sortable)


def difference(spark_side, duck_side) -> str | None:
    """None when equal, else a short description."""
    names, rows = spark_side
    duck_names, duck_rows = duck_side
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    if len(rows) != len(duck_rows):
        return f"rows {len(rows)} != {len(duck_rows)}"
    bad = [(a, b) for a, b in zip(rows, duck_rows, strict=True) if a != b or
           [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]} / {bad[-1]} for {names}"
    return None
