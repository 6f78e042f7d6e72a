"""The three dashboard reports, and ad-hoc SQL over the published tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import text, timing


def spend_facts(invoices: DataFrame) -> DataFrame:
    """Invoice-grain rows the spend reports read."""
    return invoices.select("carrier_id", "carrier_name", "gl_code", "approved_amount",
                           "invoice_date")


def performance_facts(shipments: DataFrame) -> DataFrame:
    """Shipment-grain rows the performance report reads."""
    return shipments.select(
        "carrier_id", "carrier_name",
        timing.on_time(F.col("actual_delivery"), F.col("estimated_delivery")).alias("on_time"),
        F.col("actual_delivery").alias("delivered_at"),
        F.col("weight_lbs").alias("total_weight_lbs"))


def spend_report(facts: DataFrame, as_of: date | str, days: int = 30,
                 carrier_id: str | None = None) -> DataFrame:
    """Approved spend per carrier, highest first; split by GL code when one carrier is asked for.

    ``carrier_id`` loses every character outside ``[a-zA-Z0-9_-]`` before it is compared.
    """
    recent = facts.filter(timing.since(F.col("invoice_date"), as_of, days))
    keys = ["carrier_id", "carrier_name"]
    if carrier_id is not None:
        recent = recent.filter(F.col("carrier_id") == text.clean_id(F.lit(carrier_id)))
        keys.append("gl_code")
    return (
        recent.groupBy(*keys)
        .agg(F.sum("approved_amount").cast("decimal(22,2)").alias("total_spend"),
             F.count(F.lit(1)).alias("invoice_count"))
        .orderBy(F.col("total_spend").desc_nulls_last(), *keys)
    )


def performance_report(facts: DataFrame, as_of: date | str, days: int = 30) -> DataFrame:
    """On-time share, volume and mean weight per carrier, most punctual first."""
    on_time = F.count_if("on_time").cast("decimal(14,0)") * 100
    total = F.count(F.lit(1))
    mean_weight = F.sum("total_weight_lbs") / F.nullif(F.count("total_weight_lbs"), F.lit(0))
    return (
        facts.filter(timing.since(F.col("delivered_at"), as_of, days))
        .groupBy("carrier_id", "carrier_name")
        .agg(F.round(on_time / total.cast("decimal(14,0)"), 1).cast("decimal(4,1)")
             .alias("on_time_rate_pct"),
             total.alias("total_shipments"),
             F.round(mean_weight, 0).cast("decimal(12,0)").alias("avg_weight_lbs"))
        .orderBy(F.col("on_time_rate_pct").desc(), "carrier_id", "carrier_name")
    )


def run_sql(spark: SparkSession, statement: str, database: str | None = None,
            **parameters: object) -> DataFrame:
    """Ad-hoc SQL with bound ``:name`` parameters, optionally inside a database."""
    if database is not None:
        spark.catalog.setCurrentDatabase(database)
    return spark.sql(statement, args=parameters)


def as_text(result: DataFrame) -> DataFrame:
    """Every value as text, NULL kept."""
    return result.select([F.col(f"`{c}`").cast("string").alias(c) for c in result.columns])
