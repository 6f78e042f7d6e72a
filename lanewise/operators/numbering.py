"""Reference numbers that go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.lifecycle import number_text


def next_numbers(shipments: DataFrame, issued: DataFrame, prefix: str) -> DataFrame:
    """Numbers for those of ``shipments`` that have none yet, going on after the last one of their day.

    ``issued`` (shipment_id, day, place, reference_number) is what earlier batches gave out, and what this
    gives is to be added to it.  A shipment that comes again keeps its number, so a batch may be repeated.
    One batch is numbered at a time; within it a day's numbers follow the creation hour and a hash of the
    id.  The hash cuts a busy hour into slices that are numbered side by side; what goes from slice to
    slice, and from batch to batch, is one count.
    """
    key = ["day", "hour", "bucket"]
    new = shipments.select("shipment_id", "created_at").dropDuplicates(["shipment_id"]).join(
        issued.select("shipment_id"), "shipment_id", "left_anti")
    placed = new.select(
        "shipment_id", F.to_date("created_at").alias("day"), F.hour("created_at").alias("hour"),
        F.substring(F.md5("shipment_id"), 1, 4).alias("bucket"))
    used = issued.groupBy("day").agg(F.max("place").alias("used"))
    within_day = Window.partitionBy("day").orderBy("hour", "bucket")
    offsets = (
        placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(within_day) - F.col("n"))
        .join(used, "day", "left")
        .select(*key, (F.col("before") + F.coalesce("used", F.lit(0))).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("shipment_id"))
    return (
        placed.withColumn("here", inside).join(offsets, key)
        .select("shipment_id", "day", (F.col("before") + F.col("here")).alias("place"))
        .withColumn("reference_number", number_text(prefix, F.col("day"), F.col("place")))
    )
