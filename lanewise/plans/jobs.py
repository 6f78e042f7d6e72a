"""The nightly jobs: tables in, partitioned and registered results out."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from lanewise.fixed_values import DEFAULT_LOOKBACK_DAYS
from lanewise.functions import timing
from lanewise.operators import scorecard, spend
from lanewise.sources import results


log = logging.getLogger(__name__)


def written_rows(df: DataFrame, path: str) -> int:
    """Rows below ``path``, from the files' footers; also where a day had none."""
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def columns_of(df: DataFrame, leave_out: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema
                     if f.name not in leave_out)


def run_daily_spend(spark: SparkSession, shipments: DataFrame, invoices: DataFrame, root: str,
                    day: date | str | None = None, table: str | None = None,
                    invoice_grain: str = "invoice") -> str:
    """Write the cube of a day to ``root/date=D``, split by carrier, and register it."""
    chosen = timing.spend_day(day)
    cube = spend.daily_spend(shipments, invoices, chosen, invoice_grain)
    path = results.write_partition(cube, root, {"date": chosen.isoformat()}, ["carrier_id"])
    log.info("wrote %d rows to %s", written_rows(cube, path), path)
    if table is not None:
        schema = f"{columns_of(cube, ['carrier_id'])}, date string, carrier_id string"
        results.register_table(spark, table, root, schema, ["date", "carrier_id"],
                               {"date": chosen.isoformat()})
    return path


def run_spend_backfill(shipments: DataFrame, invoices: DataFrame, root: str,
                       invoice_grain: str = "invoice") -> None:
    """Write the cubes of all days at once to ``root/date=D``, sorted by carrier.

    The daily runs split a day by carrier too.  Over all days that would be about a file per row, and a
    commit that renames each of them; here a carrier is found by the files' ranges, so the number of files
    grows with days and bytes only.  The two layouts need a root each.
    """
    cube = spend.spend_history(shipments, invoices, invoice_grain)
    results.write_partitions(cube.withColumn("date", cube["processing_date"]), root, ["date"],
                             ["carrier_id"])


def run_scorecard(spark: SparkSession, shipments: DataFrame, invoices: DataFrame, root: str,
                  as_of: date | str | None = None, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                  table: str | None = None) -> str:
    """Write the scorecard to ``root/date=D/lookback=Nd`` and register it."""
    _, last = timing.scorecard_window(as_of, lookback_days)
    scores = scorecard.carrier_scorecard(shipments, invoices, last, lookback_days)
    partition = {"date": last.isoformat(), "lookback": f"{lookback_days}d"}
    path = results.write_partition(scores, root, partition)
    log.info("wrote %d rows to %s", written_rows(scores, path), path)
    if table is not None:
        schema = f"{columns_of(scores, [])}, date string, lookback string"
        results.register_table(spark, table, root, schema, list(partition), partition)
    return path
