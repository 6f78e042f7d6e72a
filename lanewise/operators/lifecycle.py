"""Shipment life cycle: replaying status requests and the events that come out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lanewise.fixed_values import SHIPMENT_STATUSES
from lanewise.functions import messages, status, timing
from lanewise.operators.skew import on_slices

ORDER = ["ts", "event_id"]
DEFAULT_START = "CARRIER_ASSIGNED"


def replay(requests: DataFrame, unit: str = "hour") -> DataFrame:
    """Apply status requests per shipment in ``(ts, event_id)`` order.

    Needs ``shipment_id, event_id, ts, requested_status`` and optionally ``start_status``, the same
    for all rows of a shipment.  Every input row comes back with ``old_status``, ``new_status`` and
    ``accepted``; a request the state machine forbids changes nothing and is not an error.

    The state machine is a function from status to status and such functions compose.  Every
    shipment is cut into slices of one ``unit`` of time, each slice is reduced to its function, the
    functions of a shipment are chained, and the slices are replayed side by side.
    """
    if "start_status" not in requests.columns:
        requests = requests.withColumn("start_status", F.lit(DEFAULT_START))
    cut = requests.filter(F.col("shipment_id").isNotNull()).withColumn(
        "slice", F.date_trunc(unit, F.col("ts")))
    carried = [c for c in requests.columns if c not in ("shipment_id", *ORDER)]
    history = F.array_sort(F.collect_list(F.struct(*ORDER, *carried)))
    sliced = cut.groupBy("shipment_id", "slice").agg(history.alias("history"))
    empty = F.array().cast(ArrayType(StringType()))

    def step(state: Column, request: Column) -> Column:
        moved = status.next_status(state["status"], request["requested_status"])
        return F.struct(moved.alias("status"),
                        F.array_append(state["trail"], state["status"]).alias("trail"))

    start = F.struct(F.col("slice_start").alias("status"), empty.alias("trail"))
    trail = F.aggregate("history", start, step, lambda state: state["trail"])
    replayed = (
        on_slices(sliced, _slice_starts(cut), ["shipment_id"])
        .select("shipment_id", F.explode(F.arrays_zip("history", trail.alias("old_status")))
                .alias("step"))
        .select("shipment_id", "step.history.*", "step.old_status")
    )
    old, wanted = F.col("old_status"), F.col("requested_status")
    return (
        replayed.withColumn("accepted", status.may_move(old, wanted))
        .withColumn("new_status", status.next_status(old, wanted))
        .select(*requests.columns, "old_status", "new_status", "accepted")
    )


def _slice_starts(cut: DataFrame) -> DataFrame:
    """The status every (shipment, slice) begins with."""
    statuses = F.array(*map(F.lit, SHIPMENT_STATUSES))
    wanted = F.array_sort(F.collect_list(F.struct(*ORDER, "requested_status")))
    ends = F.aggregate(
        wanted, statuses, lambda now, request: F.transform(
            now, lambda one: status.next_status(one, request["requested_status"])))
    functions = cut.groupBy("shipment_id", "slice").agg(
        ends.alias("ends"), F.first("start_status", ignorenulls=True).alias("start_status"))
    # One entry per slice that a shipment touches.
    chain = F.array_sort(F.collect_list(F.struct("slice", "ends", "start_status")))
    empty = F.array().cast("array<struct<slice:timestamp,slice_start:string>>")

    def step(state: Column, link: Column) -> Column:
        here = F.struct(link["slice"].alias("slice"), state["now"].alias("slice_start"))
        position = F.array_position(statuses, state["now"]).cast("int") - 1
        after = F.coalesce(F.get(link["ends"], position), state["now"])
        return F.struct(after.alias("now"), F.array_append(state["starts"], here).alias("starts"))

    first = F.get("chain", F.lit(0))["start_status"]
    return (
        functions.groupBy("shipment_id").agg(chain.alias("chain"))
        .select("shipment_id", F.explode(F.aggregate(
            "chain", F.struct(first.alias("now"), empty.alias("starts")), step,
            lambda state: state["starts"])).alias("begin"))
        .select("shipment_id", "begin.*")
    )


def final_status(replayed: DataFrame) -> DataFrame:
    """Where each shipment stands after its last request."""
    return replayed.groupBy("shipment_id").agg(
        F.max_by("new_status", F.struct(*ORDER)).alias("status"),
        F.count_if("accepted").alias("accepted"), F.count(F.lit(1)).alias("requests"))


def assignments(requests: DataFrame) -> DataFrame:
    """Carrier assignments as status requests, so they go through the same replay."""
    return requests.withColumn("requested_status", F.lit("CARRIER_ASSIGNED"))


def assigned(replayed: DataFrame) -> DataFrame:
    """Accepted assignments: the carrier columns to set on the shipment."""
    return replayed.filter(F.col("accepted") & (F.col("new_status") == "CARRIER_ASSIGNED"))


def deliveries(replayed: DataFrame) -> DataFrame:
    """Accepted deliveries with the delivery time, punctuality and whole days early or late.

    Needs ``estimated_delivery`` of the shipment.
    """
    actual, promised = F.col("actual_delivery"), F.col("estimated_delivery")
    return (
        replayed.filter(F.col("accepted") & (F.col("new_status") == "DELIVERED"))
        .withColumn("actual_delivery", F.col("ts"))
        .withColumn("on_time", timing.on_time(actual, promised))
        .withColumn("days_variance", timing.days_variance(actual, promised))
    )


def _optional(df: DataFrame, name: str) -> Column:
    column = F.col(name) if name in df.columns else F.lit(None).cast("string")
    return column.alias(name)


def delivered_events(replayed: DataFrame) -> DataFrame:
    done = deliveries(replayed)
    return done.select(
        F.lit("ShipmentDeliveredEvent").alias("event_type"), "shipment_id", "reference_no",
        "carrier_id", "carrier_name", F.col("actual_delivery").alias("delivered_at"), "on_time",
        "days_variance", _optional(done, "pod_document_key"), _optional(done, "recipient_name"),
        "shipper_email", "consignee_email",
        F.col("declared_value").cast("double").alias("declared_value"))


def status_changed_events(replayed: DataFrame) -> DataFrame:
    """Accepted changes other than deliveries, which have an event of their own."""
    changed = replayed.filter(F.col("accepted") & (F.col("new_status") != "DELIVERED"))
    return changed.select(
        F.lit("ShipmentStatusChangedEvent").alias("event_type"), "shipment_id", "reference_no",
        "old_status", "new_status", _optional(changed, "status_reason"),
        _optional(changed, "location"), "shipper_email", "consignee_email",
        F.col("reference_no").alias("reference_display_name"),
        F.col("ts").alias("occurred_at"))


def assigned_events(replayed: DataFrame) -> DataFrame:
    done = assigned(replayed)
    return done.select(
        F.lit("CarrierAssignedEvent").alias("event_type"), "shipment_id", "reference_no",
        "carrier_id", "carrier_name", _optional(done, "rate_id"))


def created_events(shipments: DataFrame) -> DataFrame:
    """Created events: the 15 payload fields, decimals as doubles, and the message body."""
    fields = {
        "shipmentId": "shipment_id", "referenceNumber": "reference_no",
        "shipperId": "shipper_id", "shipperName": "shipper_name",
        "shipperEmail": "shipper_email", "consigneeId": "consignee_id",
        "consigneeName": "consignee_name", "consigneeEmail": "consignee_email",
        "originCity": "origin_city", "destinationCity": "dest_city", "carrierId": "carrier_id",
        "carrierName": "carrier_name", "estimatedDelivery": "estimated_delivery",
    }
    payload = [_optional(shipments, source).alias(name) for name, source in fields.items()]
    payload += [F.col("weight_lbs").cast("double").alias("weightLbs"),
                F.col("declared_value").cast("double").alias("declaredValue")]
    kind = F.lit("ShipmentCreatedEvent")
    return shipments.select(
        kind.alias("event_type"), "shipment_id",
        F.col("created_at").alias("occurred_at"),
        messages.to_body(kind.alias("eventType"), *payload).alias("body"))


def number_text(prefix: str, day: Column, place: Column) -> Column:
    """``PREFIX-yyyyMMdd-000001``; numbers of more than six digits are not cut."""
    digits = place.cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
    return F.concat(F.lit(prefix), F.lit("-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), number)


def reference_numbers(shipments: DataFrame, prefix: str) -> DataFrame:
    """Human-readable numbers ``PREFIX-yyyyMMdd-000001``, counted from 1 within each day;
    ``numbering.next_numbers`` goes on where an earlier batch ended.

    Numbers follow the creation hour and, inside an hour, a hash of the id.  The hash cuts even a
    single busy hour into 65,536 slices; a slice is numbered on its own and shifted by the size of
    the slices before it, of which a day has at most 24 times as many.
    """
    key = ["day", "hour", "bucket"]
    placed = shipments.select(
        "shipment_id", F.to_date("created_at").alias("day"), F.hour("created_at").alias("hour"),
        F.substring(F.md5("shipment_id"), 1, 4).alias("bucket"))
    within_day = Window.partitionBy("day").orderBy("hour", "bucket")
    offsets = (
        placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(within_day) - F.col("n")).drop("n")
    )
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("shipment_id"))
    return (
        placed.withColumn("place", inside).join(offsets, key)
        .select("shipment_id", number_text(prefix, F.col("day"), F.col("before") + F.col("place"))
                .alias("reference_number"))
    )
