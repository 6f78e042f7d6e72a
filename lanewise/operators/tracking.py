"""Carrier webhooks and tracking events up to the point where they touch a shipment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schemas
from lanewise.fixed_values import SUBSCRIPTIONS, TRACKING_EVENT
from lanewise.functions import messages, status
from lanewise.functions.text import or_empty
from lanewise.operators.skew import earliest

SIGNATURE_HEADER = "x-hub-signature-256"
EVENT_FIELDS = ["shipment_id", "carrier_tracking_number", "carrier_status", "status_description",
                "location"]


def signing_keys(spark: SparkSession, secrets: dict[str, str]) -> DataFrame:
    """Webhook secrets as HMAC pads, one row per configured carrier."""
    rows = [(carrier.lower(), *messages.signing_pads(s)) for carrier, s in secrets.items() if s]
    return spark.createDataFrame(rows, "key_carrier string, inner_pad binary, outer_pad binary")


def header(headers: Column, name: str) -> Column:
    """A header by case-insensitive name."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(entries, F.lit(0))["value"]


def _city(address: Column, city: str, region: str) -> Column:
    return F.concat(or_empty(address[city]), F.lit(", "), or_empty(address[region]))


def _fedex(parsed: Column, body: Column) -> list[Column]:
    info = parsed["TrackingInfo"]
    last = info["latestStatus"]
    return [info["customerTrackingId"], info["trackingNumber"], last["statusCode"],
            last["description"], _city(last["scanLocation"], "city", "stateOrProvinceCode")]


def _ups(parsed: Column, body: Column) -> list[Column]:
    shipment = parsed["shipment"]
    package = shipment["package"]
    last = F.get(package["activity"], F.lit(0))
    return [shipment["referenceNumber"], package["trackingNumber"], last["status"]["type"],
            last["description"], _city(last["location"]["address"], "city", "stateProvince")]


def _dhl(parsed: Column, body: Column) -> list[Column]:
    tracking = parsed["shipmentTrackingNumber"]
    last = F.get(parsed["events"], F.lit(0))
    named = F.array_contains(F.json_object_keys(body), "customerReference")
    return [F.when(named, parsed["customerReference"]).otherwise(tracking), tracking,
            last["status"], last["description"],
            _city(last["location"]["address"], "addressLocality", "countryCode")]


def _generic(parsed: Column, body: Column) -> list[Column]:
    return [parsed["shipmentId"], parsed["trackingNumber"], parsed["status"],
            parsed["description"], parsed["location"]]


GENERIC = "other"
PAYLOADS = {"fedex": (schemas.FEDEX_PAYLOAD, _fedex), "ups": (schemas.UPS_PAYLOAD, _ups),
            "dhl": (schemas.DHL_PAYLOAD, _dhl), GENERIC: (schemas.GENERIC_PAYLOAD, _generic)}


def normalise(requests: DataFrame) -> DataFrame:
    """Bring the four payload shapes to one; absent keys become empty text.

    The shape goes by the lower-cased carrier id of the request path.  ``payload_ok`` is false when
    the body is JSON but not of the carrier's shape.  Each body is parsed once, into a column of its
    own, and the fields are read from there.
    """
    named = [kind for kind in PAYLOADS if kind != GENERIC]
    carrier = F.lower("carrier_id")
    shaped = requests.withColumn("shape", F.when(carrier.isin(named), carrier).otherwise(GENERIC))
    parsed = shaped.withColumns({
        f"parsed_{kind}": F.from_json(F.when(F.col("shape") == kind, F.col("body")), schema,
                                      schemas.PARSE_OPTIONS)
        for kind, (schema, _) in PAYLOADS.items()})
    fields = {kind: read(F.col(f"parsed_{kind}"), F.col("body"))
              for kind, (_, read) in PAYLOADS.items()}
    columns = {}
    for i, field in enumerate(EVENT_FIELDS):
        value = F
        for kind in PAYLOADS:
            value = value.when(F.col("shape") == kind, fields[kind][i])
        columns[field] = or_empty(value)
    corrupt = F.coalesce(*[F.col(f"parsed_{kind}")[schemas.CORRUPT] for kind in PAYLOADS])
    is_object = F.json_object_keys(F.col("body")).isNotNull()
    columns["payload_ok"] = F.coalesce(is_object & corrupt.isNull(), F.lit(False))
    return parsed.withColumns(columns).drop("shape", *[f"parsed_{kind}" for kind in PAYLOADS])


def receive_webhooks(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Check, parse and normalise webhook calls; ``http_status`` and ``outcome`` classify them.

    A call without a signature, or for a carrier without a secret, is let through.  ``keys`` comes
    from :func:`signing_keys`: its size is the configuration's, so it is broadcast.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    given = header(F.col("headers"), SIGNATURE_HEADER)
    signed = (given.isNotNull()) & (given != "") & F.col("inner_pad").isNotNull()
    genuine = messages.signature(F.col("body"), F.col("inner_pad"), F.col("outer_pad")) == given
    outcome = (
        F.when(F.col("body").rlike(r"^\s*$"), "EMPTY_BODY")
        .when(signed & ~genuine, "INVALID_SIGNATURE")
        .when(F.try_parse_json(F.col("body")).isNull(), "INVALID_JSON")
        .when(~F.col("payload_ok"), "ERROR").otherwise("OK")
    )
    code = (
        F.when(F.col("outcome").isin("EMPTY_BODY", "INVALID_JSON"), 400)
        .when(F.col("outcome") == "INVALID_SIGNATURE", 401)
        .when(F.col("outcome") == "ERROR", 500).otherwise(200)
    )
    named = requests.withColumn("carrier_id", F.coalesce(F.col("carrier_id"), F.lit("unknown")))
    checked = (
        normalise(named.withColumn("body", body))
        .join(F.broadcast(keys), F.lower("carrier_id") == F.col("key_carrier"), "left")
        .withColumn("outcome", outcome)
        .withColumn("http_status", code)
    )
    kept = [F.when(F.col("outcome") == "OK", F.col(c)).alias(c) for c in EVENT_FIELDS]
    others = [c for c in requests.columns if c not in ("headers",)]
    return checked.select(*others, *kept, "outcome", "http_status")


def tracking_messages(webhooks: DataFrame) -> DataFrame:
    """Messages for accepted webhook calls, stamped with the time the call came in (``received_at``).

    The body itself carries no event type.
    """
    ok = webhooks.filter(F.col("outcome") == "OK")
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = messages.to_body(
        F.col("shipment_id").alias("shipmentId"),
        F.col("carrier_tracking_number").alias("carrierTrackingNumber"),
        F.col("carrier_status").alias("carrierStatus"),
        F.col("status_description").alias("statusDescription"), "location",
        F.col("carrier_id").alias("carrierId"), F.col("correlation_id").alias("correlationId"),
        stamp.alias("timestamp"))
    return ok.select(F.lit(TRACKING_EVENT).alias("event_type"), "carrier_id", "correlation_id",
                     body.alias("body"))


def with_event_type(queue: DataFrame) -> DataFrame:
    """Unwrap envelopes and read the type from the body ('' if it has none).

    ``readable`` is false for bodies that are not JSON; they belong in quarantine.
    """
    return (
        queue.withColumn("message", messages.unwrap(F.col("body")))
        .withColumn("body_event_type", messages.event_type(F.col("message")))
        .withColumn("readable", F.try_parse_json(F.col("message")).isNotNull())
    )


def route(events: DataFrame, topic: str = "topic", kind: str = "event_type") -> DataFrame:
    """One row per queue that a published event reaches."""
    reached = F.array().cast("array<string>")
    for name, queues in SUBSCRIPTIONS.items():
        hits = [F.when(F.lit(types is None) | F.col(kind).isin(types or []), F.lit(queue))
                for queue, types in queues.items()]
        reached = F.when(F.col(topic) == name, F.array_compact(F.array(*hits))).otherwise(reached)
    return events.withColumn("queue", F.explode(reached))


def once(events: DataFrame, keys: list[str] | None = None,
         order: list[str] | None = None) -> DataFrame:
    """At-least-once to once: one row per key (``event_id`` unless told otherwise).

    Copies are taken to be equal.  If they may differ, ``order`` says which one stays: the first.
    Rows without a key are no copies of each other; all of them stay.
    """
    keys = keys or ["event_id"]
    named = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    known = events.filter(named)
    unique = earliest(known, keys, order) if order else known.dropDuplicates(keys)
    return unique.unionByName(events.filter(~named))


def status_requests(events: DataFrame) -> DataFrame:
    """Events that ask for a status change; unmapped codes are ignored."""
    return (
        events.withColumn("requested_status", status.shipment_status(F.col("carrier_status")))
        .filter(F.col("requested_status").isNotNull())
    )


def known_shipments(requests: DataFrame, shipments: DataFrame) -> DataFrame:
    """Requests for shipments we have, with what later steps need of them."""
    needed = ["shipment_id", "reference_no", "carrier_id", "carrier_name", "estimated_delivery",
              "shipper_email", "consignee_email", "declared_value"]
    return requests.join(shipments.select(*needed), "shipment_id")


def unknown_shipments(requests: DataFrame, shipments: DataFrame) -> DataFrame:
    return requests.join(shipments.select("shipment_id"), "shipment_id", "left_anti")
