"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 1; the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from lanewise.plans.catalogue import QUERIES
from lanewise.session import configure
from lanewise.sources.sample import SCHEMAS

HEADLINE = [
    "freight_spend_daily", "freight_spend_by_shipment_grain", "carrier_scorecard",
    "carrier_scorecard_all_time", "report_spend_all", "report_performance", "shipment_search",
    "shipment_search_page", "overdue_invoices", "status_counts_since", "invoice_with_lines",
    "multi_carrier_quote", "best_quote", "rate_changes", "latest_rate_per_key",
    "rate_valid_on_date", "three_way_match", "contract_match", "invoice_events",
    "invoice_intake", "duplicate_invoices", "webhook_intake", "event_dedup", "event_routing",
    "lifecycle_fold", "lifecycle_final_status", "delivery_events", "reference_numbers",
    "document_index", "notification_outbox", "metric_counts_per_window", "alarm_p99",
    "quality_violations", "orphan_children",
]


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Run a query completely, all columns, without bringing rows to the driver."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def spread(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The freight tables' sources with as many files as there are cores, written untimed.

    The test tables are single files of one row group, which one task reads; tables of any size worth a
    cluster are not.
    """
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in SCHEMAS:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times, tables = {}, spread(spark, sf_dir, int(cpus))
    for name in HEADLINE:
        seconds(spark, name, tables)
        times[name] = round(statistics.median(
            seconds(spark, name, tables) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, median of warm runs",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
