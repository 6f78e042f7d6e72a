"""Freight-shaped tables derived from the generated star-schema test tables.

Only test data: no operator depends on this module.  Orders become shipments, suppliers become
carriers, line items become invoices, events become tracking events, webhook calls, queue messages
and log lines, documents become stored objects.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import messages, text

SHIPMENT_TYPES = ["LTL", "FTL", "PARCEL"]
WEBHOOK_CARRIERS = ["fedex", "UPS", "dhl", "acme"]
WEBHOOK_SECRETS = {"fedex": "fedex-test-secret", "ups": "ups-test-secret"}


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read as it is."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: Column | int) -> Column:
    return F.make_dt_interval(hours=n if isinstance(n, Column) else F.lit(n))


def _days(n: Column | int) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def _made_once(body: Column) -> Column:
    """A made-up message body.  Generated, so that a filter on it is not moved below and makes the
    body a second time; a stored body would just be read."""
    return F.explode(F.array(body)).alias("body")


def _digits(col: str) -> Column:
    return F.col(col).cast("string")


@lru_cache(maxsize=32)
def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    open_status = (F.when(cust % 20 == 0, "IN_TRANSIT").when(cust % 20 == 7, "OUT_FOR_DELIVERY")
                   .otherwise("DELIVERED"))
    status = (F.when(F.col("o_orderstatus") == "F", "DELIVERED")
              .when(F.col("o_orderstatus") == "O", open_status)
              .when(cust % 2 == 0, "CREATED").otherwise("CANCELLED"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    origin = nation.select(F.col("n_nationkey").alias("s_nationkey"),
                           F.col("n_name").alias("origin_state"))
    dest = nation.select(F.col("n_nationkey").alias("c_nationkey"),
                         F.col("n_name").alias("dest_state"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n_carriers = supplier.select(F.count(F.lit(1))).scalar()
    created = F.col("o_orderdate") + _hours((key % 24).cast("int"))
    promised = F.col("created_at") + _days((3 + key % 5).cast("int"))
    delay = (F.when(cust % 10 < (F.col("s_suppkey") % 4) * 2, 24 * (1 + cust % 3))
             .when(cust % 10 == 9, 1).otherwise(-30))
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                    F.lit("@example.com"))
    return (
        table(spark, sf_dir, "orders")
        .withColumn("status", status)
        .withColumn("created_at", created)
        .withColumn("estimated_delivery", promised)
        .withColumn("s_suppkey", key % n_carriers)
        .join(supplier, "s_suppkey").join(origin, "s_nationkey")
        .join(customer, "o_custkey").join(dest, "c_nationkey")
        .select(
            _digits("o_orderkey").alias("shipment_id"),
            F.concat(F.lit("REF-"), F.lpad(_digits("o_orderkey"), 8, "0")).alias("reference_no"),
            _digits("o_custkey").alias("shipper_id"),
            F.col("c_name").alias("shipper_name"),
            mail.alias("shipper_email"),
            F.concat(F.lit("Consignee "), (cust % 97).cast("string")).alias("consignee_name"),
            F.when(cust % 7 == 0, F.lit(None).cast("string")).when(cust % 11 == 0, "  ")
            .otherwise(F.concat(F.lit("dock"), _digits("o_custkey"), F.lit("@example.org")))
            .alias("consignee_email"),
            _digits("s_suppkey").alias("carrier_id"),
            F.col("s_name").alias("carrier_name"),
            F.concat(F.lit("TRK"), _digits("o_orderkey")).alias("carrier_tracking_number"),
            F.concat(F.col("origin_state"), F.lit(" City")).alias("origin_city"),
            "origin_state",
            F.concat(F.col("dest_state"), F.lit(" Town")).alias("dest_city"),
            "dest_state",
            F.get(F.array(*map(F.lit, SHIPMENT_TYPES)), (key % 3).cast("int"))
            .alias("shipment_type"),
            F.when(key % 50 != 0, (key % 997 + 100).cast("decimal(10,2)")).alias("weight_lbs"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("negotiated_rate"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("declared_value"),
            F.concat(F.lit("GL-"), F.substring("o_orderpriority", 1, 1)).alias("gl_code"),
            "status", "created_at", "estimated_delivery",
            F.when(F.col("status") == "DELIVERED",
                   F.col("estimated_delivery") + _hours(delay.cast("int")))
            .alias("actual_delivery"),
            F.col("created_at").alias("updated_at"),
        )
    )


@lru_cache(maxsize=32)
def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    lines = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(F.chr(F.max(F.ascii("l_returnflag"))).alias("flag"),
             F.min("l_shipdate").cast("date").alias("invoice_date"),
             F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(12,2)")
             .alias("invoiced_amount"))
        .withColumn("shipment_id", k.cast("string"))
    )
    owners = shipments(spark, sf_dir).select(
        "shipment_id", "carrier_id", "carrier_name", "gl_code", "created_at",
        F.col("reference_no").alias("shipment_reference_number"))
    amount = F.col("invoiced_amount")
    expected = (
        F.when(k % 5 == 0, amount)
        .when(k % 5 == 1, amount - F.lit("4.50").cast("decimal(3,2)"))
        .when(k % 5 == 2, amount * F.lit("1.01").cast("decimal(3,2)"))
        .when((k % 5 == 3) & (k % 2 == 0), amount * F.lit("0.90").cast("decimal(3,2)"))
        .when(k % 5 == 3, amount * F.lit("1.10").cast("decimal(3,2)"))
    ).cast("decimal(12,2)")
    status = (F.when((F.col("flag") == "R") & (F.col("carrier_id").cast("bigint") % 3 == 0),
                     "DISPUTED")
              .when(F.col("flag") == "R", "PAID")
              .when(F.col("flag") == "A", "APPROVED").otherwise("RECEIVED"))
    number = F.concat(F.col("shipment_id"), F.lit("-"), _digits("l_linenumber"))
    return (
        lines.join(owners, "shipment_id")
        .withColumn("expected_amount", expected)
        .withColumn("status", status)
        .select(
            number.alias("invoice_id"),
            F.concat(F.lit("INV-"), number).alias("invoice_number"),
            "shipment_id", "shipment_reference_number", "carrier_id", "carrier_name",
            "invoice_date", "invoiced_amount", "expected_amount",
            F.when(F.col("status").isin("APPROVED", "PAID"), F.col("expected_amount"))
            .alias("approved_amount"),
            F.lit("USD").alias("currency"), "gl_code", "status",
            ((F.col("status") == "APPROVED") & (k % 2 == 0)).alias("auto_approved"),
            F.date_add("invoice_date", 30).alias("payment_due_date"),
            F.when(F.col("status") == "PAID", F.col("created_at") + _days(45)).alias("paid_at"),
            "created_at",
        )
    )


@lru_cache(maxsize=32)
def carrier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every carrier serves every destination in three shipment types (a fixed fan-out of 75)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    origin = nation.select(F.col("n_nationkey").alias("s_nationkey"),
                           F.col("n_name").alias("origin_state"))
    dest = nation.select(F.col("n_nationkey").alias("dest_key"),
                         F.col("n_name").alias("dest_state"))
    lowest = nation.select(F.min("n_nationkey")).scalar()
    highest = nation.select(F.max("n_nationkey")).scalar()
    s, d = F.col("s_suppkey"), F.col("dest_key")
    return (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        .withColumn("dest_key", F.explode(F.sequence(lowest, highest)))
        .withColumn("shipment_type", F.explode(F.array(*map(F.lit, SHIPMENT_TYPES))))
        .join(origin, "s_nationkey").join(dest, "dest_key")
        .select(
            _digits("s_suppkey").alias("carrier_id"), F.col("s_name").alias("carrier_name"),
            text.lane(F.col("origin_state"), F.col("dest_state"), F.col("shipment_type"))
            .alias("lane_id"),
            "origin_state", "dest_state", "shipment_type",
            (5 + (s * 7 + d) % 11).cast("decimal(10,2)").alias("rate_per_cwt"),
            (15 + s % 8).cast("decimal(5,2)").alias("fuel_surcharge_percent"),
            F.when(s % 9 != 0, (20 + s % 30).cast("decimal(10,2)")).alias("minimum_charge"),
            (1 + (s + d) % 6).cast("int").alias("transit_days"),
            (s % 10 != 0).alias("active"),
        )
    )


def rate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive validity periods per rate card; the last one has no end."""
    rate = F.col("rate_per_cwt") + F.col("version").cast("decimal(2,0)")
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("version") * 800)
    return (
        carrier_rates(spark, sf_dir)
        .withColumn("version", F.explode(F.array(*map(F.lit, range(3)))))
        .withColumn("effective_date", start)
        .withColumn("expiration_date",
                    F.when(F.col("version") < 2, F.date_add(F.col("effective_date"), 799)))
        .withColumn("rate_per_cwt", rate.cast("decimal(10,2)"))
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with a timestamp a watermark can use."""
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.par[q]uet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tracking_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    kind = F.col("event_type")
    code = (F.when(kind == "signup", "PACKAGE_RECEIVED").when(kind == "view", "DEPARTED_FACILITY")
            .when(kind == "click", "out_for_delivery").when(kind == "purchase", "DELIVERED")
            .when(F.col("event_id") % 4 == 0, "LABEL_PRINTED").otherwise("UNABLE_TO_DELIVER"))
    return events.select(
        "event_id", "ts", _digits("user_id").alias("shipment_id"),
        code.alias("carrier_status"),
        F.concat(F.lit("value "), F.floor("value").cast("string")).alias("status_reason"),
        F.concat(F.lit("Hub "), (F.col("event_id") % 50).cast("string")).alias("location"))


def redelivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events as an at-least-once queue hands them over: every tenth one twice."""
    copies = F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)
    return (tracking_events(spark, sf_dir)
            .withColumn("delivery", F.explode(F.sequence(F.lit(1), copies))))


def incoming_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per raw line item.  Invoice numbers repeat, as (order, line) pairs do."""
    number = F.concat(F.lit("INV-"), _digits("l_orderkey"), F.lit("-"), _digits("l_linenumber"))
    line = F.struct(
        F.concat(F.lit("Part "), _digits("l_partkey")).alias("description"),
        F.get(F.array(F.lit("BASE_FREIGHT"), F.lit("FUEL_SURCHARGE"), F.lit("ACCESSORIAL"),
                      F.lit("RESIDENTIAL_DELIVERY")), (F.col("l_suppkey") % 4).cast("int"))
        .alias("charge_type"),
        F.col("l_quantity").cast("decimal(10,4)").alias("quantity"),
        (100 + F.col("l_partkey") % 900).cast("decimal(10,4)").alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total_amount"),
        F.concat(F.lit("GL-"), F.col("l_linestatus")).alias("gl_code"))
    return table(spark, sf_dir, "lineitem").select(
        number.alias("invoice_number"), _digits("l_suppkey").alias("carrier_id"),
        F.concat(F.lit("Carrier "), _digits("l_suppkey")).alias("carrier_name"),
        F.concat(F.lit("REF-"), F.lpad(_digits("l_orderkey"), 8, "0"))
        .alias("shipment_reference_number"),
        F.col("l_shipdate").cast("date").alias("invoice_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("invoiced_amount"),
        F.when(F.col("l_suppkey") % 3 == 0, "CAD").alias("currency"),
        F.concat(F.lit("GL-"), F.col("l_linestatus")).alias("gl_code"),
        F.array(line).alias("line_items"),
        F.col("l_shipdate").alias("received_at"),
        F.col("l_returnflag").alias("batch"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.explode("line_items").alias("line")
    return incoming_invoices(spark, sf_dir).select(
        F.substring_index("invoice_number", "INV-", -1).alias("invoice_id"),
        line).select("invoice_id", "line.*")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of a shipment: its distinct line numbers, in order."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("suppkey"), F.min("l_shipdate").alias("departed"))
        .select(_digits("l_orderkey").alias("shipment_id"),
                F.col("l_linenumber").alias("sequence"),
                _digits("suppkey").alias("carrier_id"),
                F.concat(F.lit("Stop "), _digits("l_linenumber")).alias("origin_city"),
                F.col("departed").alias("estimated_departure"),
                F.when(F.col("suppkey") % 5 == 0, "LOST").otherwise("IN_TRANSIT").alias("status"))
    )


def rate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates seen over time: what each shipment paid on its carrier's lane."""
    return shipments(spark, sf_dir).select(
        "carrier_id", "carrier_name", "origin_state", "dest_state", "shipment_type",
        text.lane(F.col("origin_state"), F.col("dest_state"), F.col("shipment_type"))
        .alias("lane_id"),
        F.col("negotiated_rate").alias("rate_per_cwt"),
        F.col("created_at").alias("refreshed_at"),
        F.col("shipment_id").cast("bigint").alias("refresh_id"))


def shipment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create-shipment requests with planted mistakes."""
    key = F.col("shipment_id").cast("bigint")
    return shipments(spark, sf_dir).select(
        "shipment_id", "shipper_id", "shipper_name",
        F.when(key % 17 == 0, "not-an-address").otherwise(F.col("shipper_email"))
        .alias("shipper_email"),
        F.when(key % 23 == 0, "  ").otherwise(F.col("origin_city")).alias("origin_city"),
        F.when(key % 29 == 0, F.repeat(F.lit("x"), 51)).otherwise(F.col("origin_state"))
        .alias("origin_state"),
        "dest_city", "dest_state",
        F.when(key % 31 == 0, -F.col("weight_lbs")).otherwise(F.col("weight_lbs"))
        .alias("weight_lbs"),
        F.when(key % 37 == 0, F.lit(-1).cast("decimal(12,2)")).otherwise(F.col("declared_value"))
        .alias("declared_value"),
        F.when(key % 43 == 0, F.repeat(F.lit("n"), 201)).otherwise(F.lit("Consignee"))
        .alias("consignee_name"),
        F.when(key % 41 == 0, "two@@signs").when(key % 3 != 0, "dock@example.org")
        .alias("consignee_email"),
        F.when(key % 47 == 0, F.repeat(F.lit("9"), 21)).otherwise(F.lit("90210"))
        .alias("origin_zip"),
        F.when(key % 53 == 0, F.repeat(F.lit("9"), 21)).when(key % 2 == 0, "10001")
        .alias("dest_zip"),
        F.when(key % 59 == 0, F.repeat(F.lit("s"), 1001)).when(key % 2 == 0, "ring twice")
        .alias("special_instructions"),
        "gl_code", "status")


def webhook_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier webhook calls, one per event: four payload shapes, planted faults, signatures."""
    e = tracking_events(spark, sf_dir)
    eid = F.col("event_id")
    carrier = F.get(F.array(*map(F.lit, WEBHOOK_CARRIERS)), (eid % 4).cast("int"))
    track = F.concat(F.lit("T"), eid.cast("string"))
    gone = F.lit(None).cast("string")
    city = F.when(eid % 5 != 0, F.concat(F.lit("City "), (eid % 9).cast("string")))
    fedex = messages.to_body(F.struct(
        F.col("shipment_id").alias("customerTrackingId"), track.alias("trackingNumber"),
        F.struct(F.col("carrier_status").alias("statusCode"),
                 F.col("status_reason").alias("description"),
                 F.struct(city.alias("city"), F.lit("TX").alias("stateOrProvinceCode"))
                 .alias("scanLocation")).alias("latestStatus")).alias("TrackingInfo"))
    activity = F.struct(
        F.struct(F.col("carrier_status").alias("type")).alias("status"),
        F.col("status_reason").alias("description"),
        F.struct(F.struct(city.alias("city"), F.lit("CA").alias("stateProvince"))
                 .alias("address")).alias("location"))
    older = F.struct(F.struct(F.lit("OLDER").alias("type")).alias("status"),
                     F.lit("old").alias("description"), F.lit(None).cast(
                         "struct<address:struct<city:string,stateProvince:string>>")
                     .alias("location"))
    activities = F.when(eid % 6 == 1, F.slice(F.array(activity), 1, 0)).otherwise(
        F.array(activity, older))
    ups = messages.to_body(F.struct(
        F.col("shipment_id").alias("referenceNumber"),
        F.struct(track.alias("trackingNumber"), activities.alias("activity")).alias("package"),
    ).alias("shipment"))
    dhl = messages.to_body(
        track.alias("shipmentTrackingNumber"),
        F.when(eid % 3 == 0, F.col("shipment_id")).otherwise(gone).alias("customerReference"),
        F.array(F.struct(F.col("carrier_status").alias("status"),
                         F.col("status_reason").alias("description"))).alias("events"))
    other = messages.to_body(
        F.col("shipment_id").alias("shipmentId"), track.alias("trackingNumber"),
        F.col("carrier_status").alias("status"), F.col("location").alias("location"))
    good = (F.when(eid % 4 == 0, fedex).when(eid % 4 == 1, ups).when(eid % 4 == 2, dhl)
            .otherwise(other))
    body = (F.when(eid % 41 == 0, F.lit(None).cast("string")).when(eid % 43 == 0, "  ")
            .when(eid % 37 == 0, '{"broken').when(eid % 47 == 0, "[1, 2]").otherwise(good))
    pads = {c: messages.signing_pads(s) for c, s in WEBHOOK_SECRETS.items()}
    signed = F.lit(None).cast("string")
    for name, (inner, outer) in pads.items():
        signed = F.when(F.lower(F.col("carrier_id")) == name,
                        messages.signature(F.col("body"), F.lit(inner), F.lit(outer))
                        ).otherwise(signed)
    header = F.when(eid % 53 == 0, "sha256=forged").when(eid % 7 != 0, signed)
    return (
        e.select("event_id", F.when(eid % 59 != 0, carrier).alias("carrier_id"),
                 F.col("ts").cast("timestamp").alias("received_at"), _made_once(body))
        .withColumn("headers", F.create_map(F.lit("Content-Type"), F.lit("application/json"),
                                            F.lit("X-Hub-Signature-256"), header))
        .withColumn("correlation_id", F.concat(F.lit("req-"), eid.cast("string")))
    )


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain-event messages: half in a topic envelope, some without a type, some unreadable."""
    eid = F.col("event_id")
    kinds = ["ShipmentCreatedEvent", "ShipmentStatusChangedEvent", "ShipmentDeliveredEvent",
             "InvoiceApprovedEvent", "InvoiceDisputedEvent", "CarrierRateUpdatedEvent",
             "TrackingEventReceivedEvent", "CarrierAssignedEvent"]
    kind = F.when(eid % 19 != 0, F.get(F.array(*map(F.lit, kinds)), (eid % 8).cast("int")))
    mail = F.when(eid % 3 == 0, F.lit(None).cast("string")).when(eid % 5 == 0, " ").otherwise(
        F.concat(F.lit("a"), eid.cast("string"), F.lit("@example.com")))
    other_mail = F.when(eid % 4 != 0, F.lit("team@example.org"))
    inner = messages.to_body(
        kind.alias("eventType"), F.concat(F.lit("e-"), eid.cast("string")).alias("eventId"),
        F.col("shipment_id").alias("shipmentId"),
        F.concat(F.lit("REF-"), F.col("shipment_id")).alias("referenceNumber"),
        F.when(eid % 2 == 0, "IN_TRANSIT").when(eid % 9 == 0, "OUT_FOR_DELIVERY")
        .otherwise("PICKED_UP").alias("newStatus"),
        F.when(eid % 16 == 0, "Fast Freight").alias("carrierName"),
        F.concat(F.lit("I"), eid.cast("string")).alias("invoiceId"),
        F.concat(F.lit("INV-"), eid.cast("string")).alias("invoiceNumber"),
        F.lit("OVERCHARGE").alias("disputeReason"), F.lit("TX-CA-LTL").alias("laneId"),
        (F.col("event_id") % 21 - 10).cast("double").alias("changePercentage"),
        mail.alias("shipperEmail"), other_mail.alias("consigneeEmail"),
        mail.alias("apTeamEmail"), other_mail.alias("carrierRelationsEmail"),
        other_mail.alias("procurementTeamEmail"))
    envelope = messages.to_body(
        F.lit("Notification").alias("Type"), eid.cast("string").alias("MessageId"),
        inner.alias("Message"))
    body = F.when(eid % 67 == 0, '{"eventType":').when(eid % 2 == 0, envelope).otherwise(inner)
    return tracking_events(spark, sf_dir).select("event_id", "ts", _made_once(body))


def object_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object-created messages for the documents, with encoded, short and odd keys."""
    did = F.col("doc_id")
    kind = F.get(F.array(F.lit("invoice"), F.lit("Invoice"), F.lit("pod"),
                         F.lit("bill_of_lading")), (did % 4).cast("int"))
    ending = F.get(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".tiff"), F.lit(".tar.gz"),
                           F.lit(""), F.lit(".jpeg")), (did % 6).cast("int"))
    key = F.when(did % 13 == 0, F.concat(kind, F.lit("/doc"), did.cast("string"))).otherwise(
        F.concat(kind, F.lit("/ship+"), (did % 100).cast("string"), F.lit("/doc%20"),
                 did.cast("string"), ending))
    record = F.struct(F.struct(
        F.struct(F.concat(F.lit("docs-"), F.col("lang")).alias("name")).alias("bucket"),
        F.struct(key.alias("key"), F.when(did % 9 != 0, F.col("n_chars")).alias("size"))
        .alias("object")).alias("s3"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct(F.array(record).alias("Records"))).alias("body"))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered documents as they are before indexing: every second stored object."""
    did = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter(did % 2 == 0).select(
        F.concat(F.lit("doc "), did.cast("string")).alias("document_id"),
        F.lit("old-shipment").alias("shipment_id"), F.lit("UNKNOWN").alias("document_type"),
        F.concat(F.lit("user"), (did % 10).cast("string")).alias("uploaded_by"),
        F.lit("UPLOADED").alias("status"),
        F.concat(F.lit("uploaded from "), F.col("source")).alias("description"))


def log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    kind, eid = F.col("event_type"), F.col("event_id")
    level = F.when((kind == "error") & (eid % 2 == 0), "ERROR").when(kind == "error", "ERROR_FATAL")
    return events.select(
        "event_id", "ts", level.otherwise("INFO").alias("level"),
        F.concat(F.lit("service-"), (eid % 3).cast("string")).alias("service"),
        F.lit("prod").alias("environment"),
        F.concat(F.lit("line "), eid.cast("string")).alias("message"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"))
