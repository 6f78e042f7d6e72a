"""Command line for ``spark-submit``: the nightly jobs over Parquet or JDBC tables.

    spark-submit lanewise/plans/main.py spend --shipments s3a://in/shipments \\
        --invoices s3a://in/invoices --output s3a://out/freight-spend --date 2024-03-10
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

if not __package__:  # run as a file: the package is two folders up
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lanewise.fixed_values import DEFAULT_LOOKBACK_DAYS
from lanewise.functions import timing
from lanewise.plans import jobs
from lanewise.session import configure, ship, sized_for
from lanewise.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="freight spend and carrier scorecard jobs")
    p.add_argument("job", choices=["spend", "spend-backfill", "scorecard"])
    p.add_argument("--shipments", required=True, help="Parquet path, or table name with --jdbc")
    p.add_argument("--invoices", required=True, help="Parquet path, or table name with --jdbc")
    p.add_argument("--output", required=True)
    p.add_argument("--date", help="default: yesterday for spend, today for the scorecard")
    p.add_argument("--lookback-days", type=int, default=DEFAULT_LOOKBACK_DAYS)
    p.add_argument("--grain", choices=["invoice", "shipment"], default="invoice")
    p.add_argument("--table", help="catalog table to register the result in")
    p.add_argument("--input-gb", type=int, help="size of the input, to choose partition counts")
    p.add_argument("--jdbc", help="JDBC URL; user and password come from DB_USER and DB_PASSWORD")
    p.add_argument("--jdbc-partitions", type=int, default=32)
    return p


def load(spark: SparkSession, args: argparse.Namespace, name: str, key: str, first: date,
         last: date) -> DataFrame:
    if args.jdbc:
        options = tables.jdbc_options(args.jdbc, name, first, last, args.jdbc_partitions,
                                      os.environ["DB_USER"], os.environ["DB_PASSWORD"])
        return tables.named(tables.jdbc_table(spark, options), key)
    return tables.named(tables.parquet_table(spark, name), key)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = configure(SparkSession.builder.appName(f"lanewise-{args.job}"))
    if args.input_gb:
        builder = sized_for(builder, args.input_gb << 30)
    spark = builder.getOrCreate()
    ship(spark)
    if args.job == "scorecard":
        first, last = timing.scorecard_window(args.date, args.lookback_days)
    else:
        first = last = timing.spend_day(args.date)
    inputs = [load(spark, args, name, key, first, last) for name, key in (
        (args.shipments, "shipment_id"), (args.invoices, "invoice_id"))]
    if args.job == "spend":
        jobs.run_daily_spend(spark, *inputs, args.output, last, args.table, args.grain)
    elif args.job == "spend-backfill":
        jobs.run_spend_backfill(*inputs, args.output, args.grain)
    else:
        jobs.run_scorecard(spark, *inputs, args.output, last, args.lookback_days, args.table)


if __name__ == "__main__":
    main()
