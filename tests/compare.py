"""Whole-row comparison of a Spark result with a SQL result."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from codemem.plans.views import SOURCES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in SOURCES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(columns, records) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


def spark_rows(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows(columns, cursor.fetchall())


def difference(got, want) -> str | None:
    """None when equal, otherwise a short account of the first difference."""
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return None
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    show = lambda s: [x[:400] for x in sorted(s)[:1]]
    return f"rows {len(got[1])} vs {len(want[1])}; extra {len(extra)} {show(extra)}; missing {len(missing)} {show(missing)}"
