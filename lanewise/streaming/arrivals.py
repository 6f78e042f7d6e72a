"""Requests that come in before the shipment they are for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_arrivals(requests: DataFrame, stored: DataFrame, arrivals: DataFrame, bound: str,
                  lateness: str) -> DataFrame:
    """Every request once, with ``known``: whether its shipment is stored, or arrives in time.

    ``requests`` (event_id, shipment_id, ts, ...) and ``arrivals`` (shipment_id, arrived_at) are streams,
    ``stored`` (shipment_id) is the table.  A request waits for a shipment that arrives at most ``bound``
    after it; when both watermarks have passed that time it comes out as unknown.  Requests for stored
    shipments do not wait.  State holds waiting requests and the arrivals of the last ``bound`` plus
    ``lateness`` only; a shipment that arrived earlier is in ``stored``, or in a snapshot of it that is
    older than that.  A shipment's repeated arrivals count as one as long as they are this close.
    """
    ours = stored.select(F.col("shipment_id").alias("stored_id"))
    timed = requests.withWatermark("ts", lateness).join(
        ours, F.col("shipment_id") == F.col("stored_id"), "left")
    known = timed.filter("stored_id is not null").drop("stored_id").withColumns(
        {"known": F.lit(True), "arrived_at": F.lit(None).cast("timestamp")})
    waiting = timed.filter("stored_id is null").drop("stored_id")
    came = (
        arrivals.select(F.col("shipment_id").alias("came_id"), "arrived_at")
        .withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["came_id"])
    )
    wait = F.expr(f"interval {bound}")
    met = waiting.join(came, (F.col("shipment_id") == F.col("came_id"))
                       & (F.col("arrived_at") >= F.col("ts") - wait)
                       & (F.col("arrived_at") <= F.col("ts") + wait), "leftOuter")
    return known.unionByName(
        met.withColumn("known", F.col("came_id").isNotNull()).drop("came_id"))
