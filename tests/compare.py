"""Run a catalogue query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat() + "T00:00:00"
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, otherwise what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        return (f"{sum(ours[1].values())} vs {sum(theirs[1].values())} rows, "
                f"{sum(extra.values())} only here, e.g. {list(extra)[:1]}; "
                f"{sum(missing.values())} only there, e.g. {list(missing)[:1]}")
    return None
