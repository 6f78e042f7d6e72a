"""The rolling scorecard from stored daily partial aggregates.

A day is read once, when it is closed; any window is the sum of its days.  Sums, counts and sets can be
merged exactly: averages and rates are made from them afterwards, by the code that scores raw rows.  The
one distinct count (lanes per carrier) has two forms: the days' sets of lanes, exact and as large as the
lanes that were used, or a sketch per day and carrier, a few kilobytes each, with a known error.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import DEFAULT_LOOKBACK_DAYS
from lanewise.functions import timing
from lanewise.operators import scorecard

CARRIER = ["carrier_id", "carrier_name"]
SKETCH_BITS = 12
# Three standard errors of a sketch with 2**12 registers: 1.04 / 64 each.
SKETCH_ERROR = 0.05


def shipment_days(shipments: DataFrame, sketch: bool = False) -> DataFrame:
    """Sums per day and carrier; with ``sketch`` also the day's lanes as a sketch."""
    rows = scorecard.scored_shipments(shipments).withColumnRenamed("shipment_date", "day")
    lanes = F.hll_sketch_agg(F.concat_ws("\x1f", F.length("origin_state"), "origin_state",
                                         "dest_state"), SKETCH_BITS).alias("lanes")
    return rows.groupBy("day", *CARRIER).agg(
        *scorecard.shipment_sums(), *([lanes] if sketch else []))


def lane_days(shipments: DataFrame) -> DataFrame:
    """The lanes that a carrier served on a day, each once."""
    rows = scorecard.scored_shipments(shipments).withColumnRenamed("shipment_date", "day")
    return rows.filter("origin_state is not null and dest_state is not null").select(
        "day", *CARRIER, "origin_state", "dest_state").distinct()


def invoice_days(invoices: DataFrame) -> DataFrame:
    rows = scorecard.scored_invoices(invoices).withColumnRenamed("invoice_day", "day")
    return rows.groupBy("day", "carrier_id").agg(*scorecard.invoice_sums())


def merged(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days added up: everything that is neither key, day nor sketch is a sum or a count."""
    sums = [c for c in days.columns if c not in ("day", "month", "lanes", *keys)]
    found = days.groupBy(*keys).agg(
        *[F.sum(c).cast(days.schema[c].dataType).alias(c) for c in sums],
        *([F.hll_union_agg("lanes").alias("lanes")] if "lanes" in days.columns else []))
    return found


def within(days: DataFrame, first: date, last: date) -> DataFrame:
    """The days of a window; a ``month`` column (text, yyyy-MM) is the partition they are stored in."""
    chosen = days.filter(F.col("day").between(F.lit(first), F.lit(last)))
    if "month" in days.columns:
        chosen = chosen.filter(F.col("month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))
    return chosen


def rolling_scorecard(shipments_by_day: DataFrame, invoices_by_day: DataFrame,
                      lanes_by_day: DataFrame | None = None, as_of: date | str | None = None,
                      lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> DataFrame:
    """``scorecard.carrier_scorecard`` from daily partials; exact with ``lanes_by_day``, otherwise
    lanes are estimated from the sketches of ``shipments_by_day``."""
    first, last = timing.scorecard_window(as_of, lookback_days)
    left = merged(within(shipments_by_day, first, last), CARRIER)
    if lanes_by_day is None:
        left = left.withColumn("distinct_lanes_served", F.hll_sketch_estimate("lanes"))
    else:
        lanes = within(lanes_by_day, first, last).groupBy(*CARRIER).agg(
            F.count_distinct("origin_state", "dest_state").alias("distinct_lanes_served"))
        named = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CARRIER]
        lanes = lanes.withColumnsRenamed({c: f"_{c}" for c in CARRIER})
        left = left.join(lanes, named, "left").drop(*[f"_{c}" for c in CARRIER]).withColumn(
            "distinct_lanes_served", F.coalesce("distinct_lanes_served", F.lit(0)))
    right = merged(within(invoices_by_day, first, last), ["carrier_id"])
    return scorecard.scored(left.drop("lanes"), right, first, last, lookback_days)
