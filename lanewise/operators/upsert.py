"""Keyed writes expressed as joins: full replace, partial update, delete, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import TRACKING_RETENTION_DAYS
from lanewise.operators.skew import latest


def update_columns(existing: DataFrame, updates: DataFrame, key: str, columns: list[str],
                   order: list[str]) -> DataFrame:
    """Set the named columns from ``updates``; keep all others.  Unknown keys become new rows.

    If a key occurs more than once in ``updates`` the last in ``order`` counts.  Both sides have one
    row per key when they meet.  A column set to NULL is set to NULL, not kept.
    """
    newest = latest(updates.select(key, *dict.fromkeys([*columns, *order])), [key], order)
    new = newest.select(key, F.lit(True).alias("touched"),
                        *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = existing.join(new, key, "full_outer")
    kept = existing.columns
    types = {f.name: f.dataType for f in newest.schema}

    def value(name: str):
        if name == key or name not in columns:
            return F.col(name)
        old = F.col(name) if name in kept else F.lit(None).cast(types[name])
        return F.when(F.col("touched"), F.col(f"new_{name}")).otherwise(old).alias(name)

    added = [c for c in columns if c not in kept]
    return joined.select(*[value(c) for c in [*kept, *added]])


def put_rows(existing: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replace whole rows by key, adding new ones."""
    newest = latest(rows, [key], order)
    return existing.join(newest.select(key), key, "left_anti").unionByName(
        newest, allowMissingColumns=True)


def delete_rows(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def retained(rows: DataFrame, ts: str, as_of: datetime | str,
             days: int = TRACKING_RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention time."""
    now = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return rows.filter(F.col(ts) >= F.lit((now - timedelta(days=days)).isoformat(" ")))
