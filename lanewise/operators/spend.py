"""Daily freight-spend cube: shipments and their invoices by carrier, lane and GL code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import pricing, text, timing

KEYS = ["carrier_id", "carrier_name", "origin_state", "dest_state", "gl_code", "shipment_date"]


def daily_shipments(shipments: DataFrame, day: date | None = None) -> DataFrame:
    """Delivered shipments of a day (all days if none is named), pruned to what the cube needs."""
    chosen = shipments.filter(F.col("status") == "DELIVERED")
    if day is not None:
        chosen = chosen.filter(timing.within_days(F.col("created_at"), day, day))
    return chosen.select(
        "shipment_id", "reference_no", "shipper_id", "carrier_id", "carrier_name",
        "origin_state", "dest_state", "weight_lbs", "negotiated_rate", "gl_code", "status",
        "actual_delivery", "estimated_delivery",
        timing.on_time(F.col("actual_delivery"), F.col("estimated_delivery")).alias("on_time"),
        F.to_date("created_at").alias("shipment_date"))


def daily_invoices(invoices: DataFrame, day: date | None = None) -> DataFrame:
    """Invoices of a day in any status, renamed so that no column collides with a shipment's."""
    if day is not None:
        invoices = invoices.filter(timing.within_days(F.col("created_at"), day, day))
    return invoices.select(
        "invoice_id", "invoice_number", "shipment_id",
        F.col("carrier_id").alias("invoice_carrier_id"),
        F.col("carrier_name").alias("invoice_carrier_name"),
        "invoiced_amount", "approved_amount", F.col("gl_code").alias("invoice_gl_code"),
        F.col("status").alias("invoice_status"), "auto_approved",
        F.to_date("created_at").alias("invoice_date"))


def invoice_totals(invoices: DataFrame) -> DataFrame:
    """One row per shipment and day, reduced before the join so that no shipment is hot."""
    return (
        invoices.filter(F.col("shipment_id").isNotNull())
        .groupBy("shipment_id", "invoice_date")
        .agg(F.count(F.lit(1)).alias("invoice_count"),
             F.sum("approved_amount").alias("approved_amount"),
             F.count_if(F.col("auto_approved")).alias("auto_approved_count"),
             F.count_if(F.col("invoice_status") == "DISPUTED").alias("disputed_count"))
    )


def spend_cube(shipments: DataFrame, invoices: DataFrame,
               invoice_grain: str = "invoice") -> DataFrame:
    """Aggregate freight spend.

    ``invoice_grain="invoice"``: a shipment counts once per invoice (once if it has none), and so
    do its weight, rate and on-time flag, exactly as a left join before the aggregation would have
    it.  ``"shipment"``: a shipment counts once.  ``total_invoiced_amount`` sums the *approved*
    amounts in both.  Inputs are :func:`daily_shipments` and :func:`daily_invoices`; without a day
    filter each shipment meets the invoices of its own day.
    """
    if invoice_grain not in ("invoice", "shipment"):
        raise ValueError(f"unknown invoice_grain {invoice_grain!r}")
    totals = invoice_totals(invoices).withColumnRenamed("invoice_date", "shipment_date")
    joined = shipments.join(totals, ["shipment_id", "shipment_date"], "left")
    copies = F.lit(1).cast("bigint")
    if invoice_grain == "invoice":
        copies = F.greatest(F.coalesce(F.col("invoice_count"), F.lit(1)), F.lit(1))
    times = F.col("copies").cast("decimal(13,0)")
    cube = (
        joined.withColumn("copies", copies).groupBy(*KEYS)
        .agg(
            F.sum("copies").alias("shipment_count"),
            F.sum(F.col("weight_lbs") * times).cast("decimal(28,2)").alias("total_weight_lbs"),
            F.sum(F.col("negotiated_rate") * times).cast("decimal(28,2)")
            .alias("total_negotiated_rate"),
            F.sum("approved_amount").cast("decimal(22,2)").alias("total_invoiced_amount"),
            F.sum(F.when(F.col("weight_lbs").isNotNull(), F.col("copies"))).alias("weighed"),
            F.sum(F.when(F.col("on_time"), F.col("copies")).otherwise(0)).alias("on_time_count"),
            F.coalesce(F.sum("auto_approved_count"), F.lit(0)).alias("auto_approved_count"),
            F.coalesce(F.sum("disputed_count"), F.lit(0)).alias("disputed_count"))
    )
    weight = F.col("total_weight_lbs")
    return cube.select(
        *KEYS, "shipment_count", "total_weight_lbs", "total_negotiated_rate",
        "total_invoiced_amount", pricing.ratio(weight, F.col("weighed")).alias("avg_weight_lbs"),
        "on_time_count", "auto_approved_count", "disputed_count",
        pricing.ratio(F.col("on_time_count"), F.col("shipment_count")).alias("on_time_rate"),
        pricing.ratio(F.col("auto_approved_count"), F.col("shipment_count"))
        .alias("auto_approval_rate"),
        F.when(weight > 0, pricing.ratio(F.col("total_invoiced_amount"), weight))
        .alias("cost_per_lb"),
        text.lane(F.col("origin_state"), F.col("dest_state")).alias("lane_id"))


def daily_spend(shipments: DataFrame, invoices: DataFrame, day: date | str | None = None,
                invoice_grain: str = "invoice") -> DataFrame:
    """The nightly job's result for one day (yesterday if none is named)."""
    chosen = timing.spend_day(day)
    cube = spend_cube(daily_shipments(shipments, chosen), daily_invoices(invoices, chosen),
                      invoice_grain)
    return cube.withColumn("processing_date", F.lit(chosen.isoformat()))


def spend_history(shipments: DataFrame, invoices: DataFrame,
                  invoice_grain: str = "invoice") -> DataFrame:
    """The same for every day at once: equal to the union of all daily runs."""
    cube = spend_cube(daily_shipments(shipments), daily_invoices(invoices), invoice_grain)
    return cube.withColumn("processing_date", F.date_format("shipment_date", "yyyy-MM-dd"))
