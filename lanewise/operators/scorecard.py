"""Rolling carrier scorecard: punctuality, disputes, cost, score and tier."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import (
    ACCURACY_WEIGHT, DEFAULT_LOOKBACK_DAYS, LOWEST_TIER, ON_TIME_WEIGHT, SCORED_STATUSES, TIERS,
)
from lanewise.functions import pricing, timing


def window_shipments(shipments: DataFrame, first: date, last: date) -> DataFrame:
    """Shipments created in the window, delivered or on the road, with the scored columns.

    Undelivered ones stay in and count as late.
    """
    return scored_shipments(shipments.filter(
        timing.within_days(F.col("created_at"), first, last)))


def scored_shipments(shipments: DataFrame) -> DataFrame:
    actual, promised, created = (
        F.col("actual_delivery"), F.col("estimated_delivery"), F.col("created_at"))
    return (
        shipments.filter(F.col("status").isin(SCORED_STATUSES))
        .select("shipment_id", "carrier_id", "carrier_name", "origin_state", "dest_state",
                "weight_lbs", "negotiated_rate",
                timing.on_time(actual, promised, "date").alias("on_time"),
                timing.whole_days(created, actual).alias("transit_days_actual"),
                timing.whole_days(created, promised).alias("transit_days_committed"),
                F.to_date(created).alias("shipment_date"))
    )


def window_invoices(invoices: DataFrame, first: date, last: date) -> DataFrame:
    return scored_invoices(invoices.filter(
        timing.within_days(F.col("created_at"), first, last)))


def scored_invoices(invoices: DataFrame) -> DataFrame:
    return (
        invoices.select("shipment_id", "carrier_id", "invoiced_amount", "approved_amount",
                        (F.col("status") == "DISPUTED").alias("disputed"),
                        F.to_date("created_at").alias("invoice_day"))
    )


def shipment_sums() -> list[Column]:
    """Sums and counts are kept beside the averages so that rounding stays exact."""
    return [F.count("shipment_id").alias("total_shipments"),
            F.count_if("on_time").alias("on_time_deliveries"),
            F.sum("transit_days_actual").alias("actual_days"),
            F.count("transit_days_actual").alias("actual_n"),
            F.sum("transit_days_committed").alias("committed_days"),
            F.count("transit_days_committed").alias("committed_n"),
            F.sum("weight_lbs").alias("total_weight_lbs"),
            F.count("weight_lbs").alias("weighed"),
            F.sum("negotiated_rate").alias("total_negotiated_cost")]


def invoice_sums() -> list[Column]:
    """Invoices without a shipment do not count, but their amounts do."""
    return [F.count("shipment_id").alias("total_invoices"),
            F.count_if("disputed").alias("disputed_invoices"),
            F.sum("invoiced_amount").alias("total_invoiced_amount"),
            F.sum("approved_amount").alias("total_approved_amount"),
            F.count("invoiced_amount").alias("invoiced_n")]


def shipment_metrics(shipments: DataFrame) -> DataFrame:
    """Per carrier."""
    return shipments.groupBy("carrier_id", "carrier_name").agg(
        *shipment_sums(), F.count_distinct("origin_state", "dest_state")
        .alias("distinct_lanes_served"))


def invoice_metrics(invoices: DataFrame) -> DataFrame:
    """Per carrier id."""
    return invoices.groupBy("carrier_id").agg(*invoice_sums())


def transit_variance() -> Column:
    """Difference of the two average transit times at one decimal, from exact fractions."""
    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(13,0)")
    top = wide("actual_days") * wide("committed_n") - wide("committed_days") * wide("actual_n")
    bottom = F.nullif(wide("actual_n") * wide("committed_n"), F.lit(0))
    return F.round(top / bottom, 1).cast("decimal(12,1)")


def tier(score: Column) -> Column:
    ladder = F
    for least, name in TIERS:
        ladder = ladder.when(score >= F.lit(least).cast("decimal(5,1)"), name)
    return ladder.otherwise(LOWEST_TIER)


def carrier_scorecard(shipments: DataFrame, invoices: DataFrame, as_of: date | str | None = None,
                      lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> DataFrame:
    """Score every carrier over the window ending at ``as_of`` (today if not named).

    Both sides are aggregated to carrier grain before they meet, so the join is tiny.  Carriers are
    told apart by id and name, invoices only by id: a renamed carrier sees its invoices twice.
    """
    first, last = timing.scorecard_window(as_of, lookback_days)
    return scored(shipment_metrics(window_shipments(shipments, first, last)),
                  invoice_metrics(window_invoices(invoices, first, last)), first, last, lookback_days)


def scored(left: DataFrame, right: DataFrame, first: date, last: date,
           lookback_days: int) -> DataFrame:
    """Rates, averages, score and tier from the sums of both sides."""
    weight = F.col("total_weight_lbs")
    cost = F.col("total_approved_amount").cast("decimal(22,2)") / weight.cast("decimal(20,2)")
    disputes = pricing.percent_of(F.col("disputed_invoices"), F.col("total_invoices"))
    score = (F.col("on_time_rate_pct") * pricing.decimal_lit(ON_TIME_WEIGHT, 2, 1)
             + (100 - F.col("dispute_rate_pct")) * pricing.decimal_lit(ACCURACY_WEIGHT, 2, 1))
    kpis = (
        left.join(right, "carrier_id", "left")
        .withColumns({
            "avg_actual_transit_days": pricing.ratio(F.col("actual_days"), F.col("actual_n")),
            "avg_committed_transit_days":
                pricing.ratio(F.col("committed_days"), F.col("committed_n")),
            "avg_shipment_weight_lbs": pricing.ratio(weight, F.col("weighed")),
            "avg_invoice_amount":
                pricing.ratio(F.col("total_invoiced_amount"), F.col("invoiced_n")),
            "on_time_rate_pct":
                pricing.percent_of(F.col("on_time_deliveries"), F.col("total_shipments")),
            "dispute_rate_pct": F.coalesce(disputes, F.lit(0).cast("decimal(9,2)")),
            "cost_per_lb": F.when(weight > 0, F.round(cost, 4).cast("decimal(20,4)")),
            "transit_days_variance": transit_variance(),
        })
        .withColumn("overall_score", F.round(score, 1).cast("decimal(5,1)"))
        .withColumns({
            "carrier_tier": tier(F.col("overall_score")),
            "processing_date": F.lit(last.isoformat()),
            "lookback_days": F.lit(lookback_days),
            "window_start": F.lit(first.isoformat()),
        })
    )
    return kpis.drop("actual_days", "actual_n", "committed_days", "committed_n", "weighed",
                     "invoiced_n")
