"""Every operator as a query over the test tables: name -> (spark, directory) -> DataFrame.

Results use plain column types (integers, doubles, decimals as doubles, text, dates, timestamps), so
that another engine can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, MapType, StructType

from lanewise.functions import messages, pricing, status, text, timing
from lanewise.operators import (
    documents, lifecycle, matching, metrics, outbox, quality, rates, reports, scorecard, search,
    spend, tracking, upsert,
)
from lanewise.plans import jobs, live
from lanewise.session import shared_dir
from lanewise.sources import batches, sample
from lanewise.streaming import pipeline, state

Query = Callable[[SparkSession, str], DataFrame]

SCORECARD_DAY = "1998-06-30"
REPORT_DAY = "1998-07-01"
AVERAGE_MS, P99_MS, SUM_MS = 500.0, 2000.0, 2500.0
SHIPMENT_SERVICE, NOTIFIER, ENVIRONMENT = "shipment-service", "notification-service", "test"
BASE_URL = "https://freight.example.com"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, maps and structs as JSON text."""
    shown = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            column = F.to_json(column)
        shown.append(column.alias(field.name))
    return df.select(shown)


# Spend, scorecard, reports

def freight_spend_daily(spark: SparkSession, d: str) -> DataFrame:
    return plain(spend.spend_history(sample.shipments(spark, d), sample.invoices(spark, d)))


def freight_spend_by_shipment_grain(spark: SparkSession, d: str) -> DataFrame:
    return plain(spend.spend_history(sample.shipments(spark, d), sample.invoices(spark, d),
                                     invoice_grain="shipment"))


def freight_spend_one_day(spark: SparkSession, d: str) -> DataFrame:
    return plain(spend.daily_spend(sample.shipments(spark, d), sample.invoices(spark, d),
                                   "1998-03-15"))


def carrier_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return plain(scorecard.carrier_scorecard(
        sample.shipments(spark, d), sample.invoices(spark, d), SCORECARD_DAY))


def carrier_scorecard_all_time(spark: SparkSession, d: str) -> DataFrame:
    return plain(scorecard.carrier_scorecard(
        sample.shipments(spark, d), sample.invoices(spark, d), "2001-12-31", 3000))


def report_spend_all(spark: SparkSession, d: str) -> DataFrame:
    facts = reports.spend_facts(sample.invoices(spark, d))
    return plain(reports.spend_report(facts, REPORT_DAY, 365))


def report_spend_carrier(spark: SparkSession, d: str) -> DataFrame:
    facts = reports.spend_facts(sample.invoices(spark, d))
    return plain(reports.spend_report(facts, REPORT_DAY, 365, carrier_id="'7';"))


def report_performance(spark: SparkSession, d: str) -> DataFrame:
    facts = reports.performance_facts(sample.shipments(spark, d))
    return plain(reports.performance_report(facts, REPORT_DAY, 180))


def report_spend_as_text(spark: SparkSession, d: str) -> DataFrame:
    facts = reports.spend_facts(sample.invoices(spark, d))
    return reports.as_text(reports.spend_report(facts, REPORT_DAY, 30))


def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    reports.spend_facts(sample.invoices(spark, d)).createOrReplaceTempView("lanewise_spend_facts")
    return plain(reports.run_sql(
        spark, "SELECT gl_code, count(*) AS invoices, sum(approved_amount) AS approved "
               "FROM lanewise_spend_facts WHERE approved_amount >= :least GROUP BY gl_code",
        least=1000))


# Searches

def shipment_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_shipments(
        sample.shipments(spark, d), status="DELIVERED", from_date="1996-01-01",
        to_date="1999-12-31 12:00:00", origin_city="nation_1", dest_city="TOWN")
    return plain(search.shipment_view(found))


def shipment_search_page(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_shipments(sample.shipments(spark, d), origin_city="NATION")
    return plain(search.page(search.shipment_view(found), "shipment_id", number=2, size=50))


def shipment_page_after(spark: SparkSession, d: str) -> DataFrame:
    view = search.shipment_view(sample.shipments(spark, d))
    return plain(search.page_after(view, "shipment_id", "1998-05-05 05:00:00", "5", size=100))


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.page_totals(sample.shipments(spark, d), number=3)


def shipper_history(spark: SparkSession, d: str) -> DataFrame:
    mine = search.find(sample.shipments(spark, d), shipper_id="77")
    return plain(search.newest_first(search.shipment_view(mine), "shipment_id"))


def invoice_listing(spark: SparkSession, d: str) -> DataFrame:
    chosen = search.list_invoices(sample.invoices(spark, d), status="DISPUTED", carrier_id="7")
    return plain(chosen.select("invoice_id", "carrier_id", "status", "invoiced_amount"))


def carrier_invoices(spark: SparkSession, d: str) -> DataFrame:
    chosen = search.list_invoices(sample.invoices(spark, d), carrier_id="7")
    return plain(chosen.select("invoice_id", "shipment_id", "status", "invoiced_amount"))


def overdue_shipments(spark: SparkSession, d: str) -> DataFrame:
    late = search.overdue_shipments(sample.shipments(spark, d), "1999-01-01 00:00:00")
    return late.select("shipment_id", "status", "estimated_delivery")


def overdue_invoices(spark: SparkSession, d: str) -> DataFrame:
    due = search.overdue_invoices(sample.invoices(spark, d), "1999-01-01")
    return plain(due.select("invoice_id", "payment_due_date", "approved_amount"))


def status_counts_since(spark: SparkSession, d: str) -> DataFrame:
    return search.status_counts(sample.shipments(spark, d), "1997-01-01")


def invoice_with_lines(spark: SparkSession, d: str) -> DataFrame:
    parents = sample.invoices(spark, d).select("invoice_id", "invoice_number", "status")
    nested = search.invoice_with_lines(parents, sample.line_items(spark, d))
    shown = F.transform("line_items", lambda line: F.concat_ws(
        ":", line["description"], line["charge_type"], line["total_amount"].cast("string")))
    return nested.select("invoice_id", "invoice_number", "status", "part",
                         F.array_join(shown, ";").alias("line_items"))


def shipment_with_legs(spark: SparkSession, d: str) -> DataFrame:
    parents = sample.shipments(spark, d).select("shipment_id", "status")
    nested = search.shipment_with_legs(parents, sample.legs(spark, d))
    shown = F.transform("legs", lambda leg: F.concat_ws(
        ":", leg["sequence"].cast("string"), leg["carrier_id"]))
    return nested.select("shipment_id", "status", "part",
                         F.size("legs").cast("bigint").alias("leg_count"),
                         F.array_join(shown, ";").alias("legs"))


# Rates

def multi_carrier_quote(spark: SparkSession, d: str) -> DataFrame:
    requests = rates.quote_requests(sample.shipments(spark, d))
    return plain(rates.carrier_quotes(requests, sample.carrier_rates(spark, d)))


def best_quote(spark: SparkSession, d: str) -> DataFrame:
    requests = rates.quote_requests(sample.shipments(spark, d))
    return plain(rates.best_quotes(requests, sample.carrier_rates(spark, d)))


def ranked_quotes(spark: SparkSession, d: str) -> DataFrame:
    requests = rates.quote_requests(sample.shipments(spark, d))
    return plain(rates.ranked_quotes(requests, sample.carrier_rates(spark, d)).drop(
        "carrier_name", "transit_days"))


def rate_lookup(spark: SparkSession, d: str) -> DataFrame:
    cards = rates.active(sample.carrier_rates(spark, d))
    return plain(search.find(cards, carrier_id="7", shipment_type="LTL"))


def weight_buckets(spark: SparkSession, d: str) -> DataFrame:
    bucket = pricing.weight_bucket(F.col("weight_lbs")).alias("bucket")
    return (sample.shipments(spark, d).groupBy(bucket)
            .agg(F.count(F.lit(1)).alias("shipments")))


def rate_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = rates.rate_changes(sample.rate_history(spark, d))
    return plain(changes.select("carrier_id", "lane_id", "refreshed_at", "refresh_id",
                                "previous_rate", "new_rate", "change_percent", "rate_increased"))


def latest_rate_per_key(spark: SparkSession, d: str) -> DataFrame:
    newest = rates.newest_rates(sample.rate_history(spark, d), ["refreshed_at", "refresh_id"])
    return plain(newest.select("carrier_id", "lane_id", "refresh_id", "rate_per_cwt"))


def rate_upsert(spark: SparkSession, d: str) -> DataFrame:
    history = sample.rate_history(spark, d)
    old = history.filter(F.col("refreshed_at") < "1998-01-01")
    new = history.filter(F.col("refreshed_at") >= "1998-01-01")
    order = ["refreshed_at", "refresh_id"]
    table = rates.upsert_rates(rates.newest_rates(old, order), new, order)
    return plain(table.select("carrier_id", "lane_id", "refresh_id", "rate_per_cwt"))


def rate_valid_on_date(spark: SparkSession, d: str) -> DataFrame:
    shipments = sample.shipments(spark, d)
    requests = shipments.select(
        "shipment_id", "carrier_id", "created_at",
        text.lane(F.col("origin_state"), F.col("dest_state"), F.col("shipment_type"))
        .alias("lane_id"))
    found = rates.rates_on(sample.rate_versions(spark, d), requests, "created_at", "shipment_id")
    return plain(found.select("shipment_id", "effective_date", "rate_per_cwt"))


def _refresh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nth = F.col("s_suppkey").cast("string")
    carriers = sample.table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") == 0, "FedEx").when(F.col("s_suppkey") == 10, "dhl")
        .otherwise(nth).alias("carrier_id"))
    fresh = rates.active(sample.carrier_rates(spark, d)).select(
        "carrier_id", "lane_id", "origin_state", "dest_state", "shipment_type",
        F.when((F.col("carrier_id") == "7") & (F.col("shipment_type") == "FTL"), "n/a")
        .otherwise(F.col("rate_per_cwt").cast("string")).alias("rate_per_cwt"),
        F.col("fuel_surcharge_percent").cast("string").alias("fuel_surcharge_percent"),
        F.col("minimum_charge").cast("string").alias("minimum_charge"), "transit_days")
    return carriers, rates.with_fallback(carriers, fresh, rates.literal_cards(spark))


def rate_fallback(spark: SparkSession, d: str) -> DataFrame:
    stored = rates.refreshed(_refresh(spark, d)[1], "1998-01-01 06:00:00")
    return plain(stored.drop("last_refreshed_at"))


def rate_refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    return rates.refresh_counts(*_refresh(spark, d))


def rate_event_messages(spark: SparkSession, d: str) -> DataFrame:
    cards = sample.carrier_rates(spark, d).withColumn(
        "last_refreshed_at", F.lit("1998-01-01 06:00:00").cast("timestamp"))
    sent = rates.rate_event_messages(cards)
    return sent.select(
        "event_type", "carrier_id", "lane_id",
        *[F.get_json_object("body", f"$.{f}").alias(f) for f in (
            "eventType", "originState", "destinationState", "ratePerCwt", "effectiveDate")])


# Invoices

def _matchable(spark: SparkSession, d: str) -> DataFrame:
    return sample.invoices(spark, d).withColumn("shipment_found", F.lit(True))


MATCH_COLUMNS = ["invoice_id", "match_outcome", "match_reason", "match_description", "status",
                 "auto_approved", "approved_amount", "dispute_reason", "dispute_description"]


def three_way_match(spark: SparkSession, d: str) -> DataFrame:
    return plain(matching.three_way_match(_matchable(spark, d)).select(*MATCH_COLUMNS))


def contract_match(spark: SparkSession, d: str) -> DataFrame:
    known = sample.shipments(spark, d).filter(F.col("status") != "CANCELLED")
    ready = matching.with_expected(sample.invoices(spark, d), known,
                                   sample.carrier_rates(spark, d))
    matched = matching.three_way_match(ready)
    return plain(matched.select("expected_amount", *MATCH_COLUMNS))


def match_on_delivery(spark: SparkSession, d: str) -> DataFrame:
    delivered = sample.shipments(spark, d).filter(F.col("status") == "DELIVERED")
    matched = matching.match_on_delivery(delivered, sample.invoices(spark, d))
    return matched.groupBy("match_outcome", "match_reason").agg(
        F.count(F.lit(1)).alias("invoices"))


def invoice_events(spark: SparkSession, d: str) -> DataFrame:
    matched = matching.three_way_match(
        _matchable(spark, d),
        now=F.col("payment_due_date").cast("timestamp") + F.make_dt_interval(hours=F.lit(1)))
    events = matching.invoice_events(matched)
    return plain(events.drop("carrier_name", "shipment_reference_number", "dispute_description"))


def discrepancy_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = matching.with_discrepancy_flag(sample.invoices(spark, d), "100.00")
    amounts = [F.col("invoiced_amount"), F.col("expected_amount")]
    return plain(flagged.select("invoice_id", "has_discrepancy",
                                pricing.discrepancy(*amounts).alias("discrepancy"),
                                pricing.discrepancy_percent(*amounts).alias("percent")))


INTAKE_ORDER = ["received_at", "invoiced_amount", "carrier_id", "gl_code", "currency",
                "line_items", "batch"]


def _intake(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    incoming = sample.incoming_invoices(spark, d)
    known = incoming.filter(F.col("batch") == "A").select("invoice_number").distinct()
    return incoming.filter(F.col("batch") != "A"), known


def invoice_intake(spark: SparkSession, d: str) -> DataFrame:
    accepted = matching.take_in(*_intake(spark, d), INTAKE_ORDER)
    return plain(accepted.select("invoice_number", "carrier_id", "invoiced_amount", "currency",
                                 "status", "invoice_date", "payment_due_date"))


def intake_line_items(spark: SparkSession, d: str) -> DataFrame:
    accepted = matching.take_in(*_intake(spark, d), INTAKE_ORDER)
    return plain(matching.exploded_lines(accepted))


def duplicate_invoices(spark: SparkSession, d: str) -> DataFrame:
    return matching.rejected_requests(*_intake(spark, d))


def line_rollup(spark: SparkSession, d: str) -> DataFrame:
    return plain(matching.line_rollup(sample.line_items(spark, d)))


def manual_approval(spark: SparkSession, d: str) -> DataFrame:
    invoices = sample.invoices(spark, d)
    approvals = invoices.filter(F.col("status") == "DISPUTED").select(
        "invoice_id", F.col("created_at").alias("approved_at"),
        F.lit("ap-team").alias("approved_by"))
    done = matching.approve(invoices, approvals)
    return plain(done.select("invoice_id", "status", "approved_amount", "approved_by",
                             "approved_at"))


def approval_events(spark: SparkSession, d: str) -> DataFrame:
    """Disputed invoices approved by hand; stored approvals of others do not count again."""
    invoices = sample.invoices(spark, d).withColumns({
        "approved_at": F.lit("2001-01-01").cast("timestamp"), "approved_by": F.lit("before")})
    approvals = invoices.filter(F.col("status") == "DISPUTED").select(
        "invoice_id", F.col("created_at").alias("approved_at"),
        F.lit("ap-team").alias("approved_by"))
    events = matching.approval_events(matching.approve(invoices, approvals))
    return plain(events.select("event_type", "invoice_id", "carrier_id", "shipment_id",
                               "approved_amount", "gl_code", "auto_approved", "approved_at"))


def undecided_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Invoices whose amount is unknown are never approved."""
    unknown = _matchable(spark, d).withColumn(
        "invoiced_amount", F.lit(None).cast("decimal(12,2)"))
    matched = matching.three_way_match(unknown, now="2001-01-01")
    return plain(matched.select("invoice_id", "match_outcome", "match_reason", "status",
                                "auto_approved", "approved_amount", "approved_at"))


def paid_invoices(spark: SparkSession, d: str) -> DataFrame:
    invoices = sample.invoices(spark, d)
    paid = invoices.filter(F.col("auto_approved")).select(
        "invoice_id", (F.col("created_at") + F.make_dt_interval(days=F.lit(20))).alias("paid_at"))
    return matching.mark_paid(invoices, paid).select("invoice_id", "status", "paid_at")


# Tracking

def webhook_intake(spark: SparkSession, d: str) -> DataFrame:
    keys = tracking.signing_keys(spark, sample.WEBHOOK_SECRETS)
    seen = tracking.receive_webhooks(sample.webhook_requests(spark, d), keys)
    return seen.drop("body", "correlation_id", "received_at")


def webhook_outcomes(spark: SparkSession, d: str) -> DataFrame:
    keys = tracking.signing_keys(spark, sample.WEBHOOK_SECRETS)
    seen = tracking.receive_webhooks(sample.webhook_requests(spark, d), keys)
    return seen.groupBy("outcome", "http_status").agg(F.count(F.lit(1)).alias("calls"))


def tracking_messages(spark: SparkSession, d: str) -> DataFrame:
    keys = tracking.signing_keys(spark, sample.WEBHOOK_SECRETS)
    sent = tracking.tracking_messages(
        tracking.receive_webhooks(sample.webhook_requests(spark, d), keys))
    fields = ["shipmentId", "carrierTrackingNumber", "carrierStatus", "statusDescription",
              "location", "carrierId", "correlationId", "timestamp"]
    return sent.select(
        "event_type", "carrier_id", "correlation_id",
        *[F.get_json_object("body", f"$.{name}").alias(f"body_{name}") for name in fields],
        messages.event_type(F.col("body")).alias("body_event_type"))


def message_types(spark: SparkSession, d: str) -> DataFrame:
    read = tracking.with_event_type(sample.queue_messages(spark, d))
    return read.select("event_id", "body_event_type", "readable")


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    read = tracking.with_event_type(sample.queue_messages(spark, d))
    return read.groupBy("readable").agg(F.count(F.lit(1)).alias("messages"))


def event_routing(spark: SparkSession, d: str) -> DataFrame:
    read = tracking.with_event_type(sample.queue_messages(spark, d)).filter("readable")
    topic = F.when(F.startswith(F.col("body_event_type"), F.lit("Invoice")), "invoice-events")
    routed = tracking.route(read.withColumn("topic", topic.otherwise("shipment-events")),
                            kind="body_event_type")
    return routed.select("event_id", "topic", "queue")


def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    once = tracking.once(sample.redelivered_events(spark, d), order=["delivery"])
    return once.select("event_id", "shipment_id", "carrier_status", "ts")


def status_mapping(spark: SparkSession, d: str) -> DataFrame:
    events = sample.tracking_events(spark, d)
    mapped = events.withColumn("status", status.shipment_status(F.col("carrier_status")))
    return mapped.groupBy("carrier_status", "status").agg(F.count(F.lit(1)).alias("events"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return tracking.status_requests(tracking.once(sample.tracking_events(spark, d)))


def known_and_unknown_shipments(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d)
    ours = sample.shipments(spark, d).filter(F.col("status") != "CANCELLED")
    known = tracking.known_shipments(requests, ours).select(
        "event_id", "shipment_id", F.lit(True).alias("known"))
    unknown = tracking.unknown_shipments(requests, ours).select(
        "event_id", "shipment_id", F.lit(False).alias("known"))
    return known.unionByName(unknown)


# Life cycle

def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.replay(_requests(spark, d)).select(
        "event_id", "shipment_id", "ts", "requested_status", "old_status", "new_status",
        "accepted")


def lifecycle_fold_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The same result with every shipment treated as a hot one."""
    return lifecycle.replay(_requests(spark, d), unit="minute").select(
        "event_id", "shipment_id", "ts", "requested_status", "old_status", "new_status",
        "accepted")


def lifecycle_final_status(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.final_status(lifecycle.replay(_requests(spark, d)))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """Replayed first, while rows are narrow; the shipment's columns join the outcome."""
    return tracking.known_shipments(lifecycle.replay(_requests(spark, d)),
                                    sample.shipments(spark, d))


def delivery_events(spark: SparkSession, d: str) -> DataFrame:
    return plain(lifecycle.delivered_events(_replayed(spark, d))
                 .drop("pod_document_key", "recipient_name"))


def status_changed_events(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_changed_events(_replayed(spark, d))


def carrier_assignment(spark: SparkSession, d: str) -> DataFrame:
    shipments = sample.shipments(spark, d)
    wanted = lifecycle.assignments(shipments.withColumn("start_status", F.col("status")).select(
        "shipment_id", F.col("shipment_id").cast("bigint").alias("event_id"),
        F.col("created_at").alias("ts"), "start_status", "reference_no", "carrier_id",
        "carrier_name", F.concat("carrier_id", F.lit(":"), "shipment_type").alias("rate_id")))
    return lifecycle.assigned_events(lifecycle.replay(wanted))


def created_events(spark: SparkSession, d: str) -> DataFrame:
    return _created_fields(lifecycle.created_events(sample.shipments(spark, d)))


def _created_fields(made: DataFrame) -> DataFrame:
    fields = ["eventType", "referenceNumber", "shipperName", "originCity", "carrierId",
              "consigneeEmail", "estimatedDelivery"]
    return made.select("event_type", "shipment_id",
                       *[F.get_json_object("body", f"$.{f}").alias(f) for f in fields],
                       F.get_json_object("body", "$.weightLbs").cast("double").alias("weightLbs"))


def delivery_variance(spark: SparkSession, d: str) -> DataFrame:
    actual, promised = F.col("actual_delivery"), F.col("estimated_delivery")
    return sample.shipments(spark, d).select(
        "shipment_id", timing.on_time(actual, promised).alias("on_time"),
        timing.on_time(actual, promised, "date").alias("on_time_by_date"),
        timing.days_variance(actual, promised).alias("days_variance"),
        timing.whole_days(F.col("created_at"), actual).alias("transit_days"))


def reference_numbers(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reference_numbers(sample.shipments(spark, d), "SH")


# Streams, run to the end of what there is

def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    events = sample.tracking_events(spark, d, sample.event_stream(spark, d))
    requests = tracking.status_requests(pipeline.once(events)).withColumn(
        "start_status", F.lit(lifecycle.DEFAULT_START))
    judged = pipeline.drain(state.replay_stream(requests))
    return judged.select("event_id", "shipment_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                         "requested_status", "old_status", "new_status", "accepted")


def stream_error_counts(spark: SparkSession, d: str) -> DataFrame:
    logs = sample.log_lines(spark, d, sample.event_stream(spark, d))
    samples = metrics.samples(metrics.error_lines(logs), "ts", "ErrorCount",
                              service=F.col("service"))
    counted = pipeline.drain_latest(pipeline.live_counters(samples),
                                    ["period_start", "metric", "tags"])
    return counted.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


# Documents

def _stored_objects(spark: SparkSession, d: str) -> DataFrame:
    return documents.objects(sample.object_notifications(spark, d))


def document_key_parse(spark: SparkSession, d: str) -> DataFrame:
    return documents.parse_keys(_stored_objects(spark, d))


def document_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.batch_counts(documents.parse_keys(_stored_objects(spark, d)))


def document_index(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    updates = documents.index_updates(documents.parse_keys(_stored_objects(spark, d)), stamp)
    return documents.index_documents(sample.document_metadata(spark, d), updates)


def documents_of_shipment(spark: SparkSession, d: str) -> DataFrame:
    return search.find(document_index(spark, d), shipment_id="ship 7").select(
        "document_id", "s3_key", "content_type", "status")


def document_register(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.lit("2024-03-11 00:00:00").cast("timestamp_ntz")
    existing = sample.document_metadata(spark, d)
    requests = sample.table(spark, d, "documents").filter(F.col("doc_id") % 3 == 0).select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("document_id"),
        F.lit("s-new").alias("shipment_id"), F.lit("POD").alias("document_type"),
        text.object_key(F.lit("POD"), F.lit("s-new"), F.col("doc_id").cast("string"),
                        F.lit("png")).alias("s3_key"),
        F.lit("clerk").alias("uploaded_by"), F.lit("again").alias("description"),
        text.content_type(F.lit("tiff"), "upload").alias("content_type"))
    return documents.register(existing.withColumns({
        "s3_key": F.lit(None).cast("string"), "content_type": F.lit(None).cast("string"),
        "uploaded_at": F.lit(None).cast("timestamp_ntz")}), requests, stamp)


def document_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = sample.table(spark, d, "labels").filter(F.col("toxic") == 1).select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("document_id"))
    kept = upsert.delete_rows(sample.document_metadata(spark, d), gone, "document_id")
    return kept.select("document_id", "uploaded_by", "description")


def ocr_jobs(spark: SparkSession, d: str) -> DataFrame:
    candidates = documents.ocr_candidates(_stored_objects(spark, d))
    job = F.concat(F.lit("job-"), F.col("doc_id").cast("string"))
    stamp = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    return documents.ocr_messages(candidates, job, stamp).select(
        "event_type", "job_id", "document_id", "shipment_id", "s3_key", "s3_bucket",
        F.get_json_object("body", "$.startedAt").alias("started_at"))


def ocr_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.ocr_counts(documents.ocr_candidates(_stored_objects(spark, d)))


def ocr_job_documents(spark: SparkSession, d: str) -> DataFrame:
    candidates = documents.ocr_candidates(_stored_objects(spark, d))
    jobs = candidates.filter(F.col("ocr_outcome") == "STARTED").select(
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), "document_id",
        F.regexp_replace("shipment_id", "^ship ", "").alias("shipment_id"))
    return documents.jobs_with_documents(jobs, document_index(spark, d),
                                         sample.shipments(spark, d))


# Notifications

def _mails(spark: SparkSession, d: str) -> DataFrame:
    read = tracking.with_event_type(sample.queue_messages(spark, d)).filter("readable")
    return outbox.outbox(read, BASE_URL)


def notification_outbox(spark: SparkSession, d: str) -> DataFrame:
    variables = F.col("variables")
    return _mails(spark, d).select(
        "event_id", "template", "subject", F.array_join("recipients", ",").alias("recipients"),
        "is_deliverable", F.size(variables).alias("variable_count"),
        F.coalesce(F.try_element_at(variables, F.lit("trackingUrl")),
                   F.try_element_at(variables, F.lit("invoiceUrl"))).alias("link"),
        F.try_element_at(variables, F.lit("carrierName")).alias("carrier_name"),
        F.try_element_at(variables, F.lit("rateIncreased")).alias("rate_increased"))


def display_values(spark: SparkSession, d: str) -> DataFrame:
    percent = pricing.discrepancy_percent(F.col("invoiced_amount"), F.col("expected_amount"))
    return sample.invoices(spark, d).select(
        "invoice_id", text.show_money(F.col("invoiced_amount")).alias("amount"),
        text.show_date(F.col("payment_due_date")).alias("due"),
        text.show_percent(F.abs(percent)).alias("percent"),
        text.invoice_url(BASE_URL, F.col("invoice_id")).alias("link"))


def places_and_lanes(spark: SparkSession, d: str) -> DataFrame:
    origin, dest = F.col("origin_state"), F.col("dest_state")
    return sample.shipments(spark, d).groupBy(
        text.place(F.col("origin_city"), origin).alias("origin"),
        text.lane(origin, dest).alias("spend_lane"),
        text.lane(origin, dest, F.col("shipment_type")).alias("rate_lane"),
    ).agg(F.count(F.lit(1)).alias("shipments"))


# Metrics

def _samples(spark: SparkSession, d: str) -> DataFrame:
    shipments = sample.shipments(spark, d)
    on_time = timing.on_time(F.col("actual_delivery"), F.col("estimated_delivery"))
    created = metrics.samples(shipments, "created_at", "shipment.created.count")
    delivered = metrics.samples(shipments.filter("actual_delivery IS NOT NULL"),
                                "actual_delivery", "shipment.delivered.count", on_time=on_time)
    changed = metrics.samples(
        lifecycle.replay(_requests(spark, d)).filter("accepted"), "ts",
        "shipment.status.change.count", old=F.col("old_status"), new=F.col("new_status"))
    return created.unionByName(delivered).unionByName(changed)


def metric_counts_per_window(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(metrics.with_common_tags(
        _samples(spark, d), SHIPMENT_SERVICE, ENVIRONMENT))


def duration_timers(spark: SparkSession, d: str) -> DataFrame:
    return metrics.timers(sample.log_lines(spark, d), "duration_ms", ["service", "environment"])


def error_counts(spark: SparkSession, d: str) -> DataFrame:
    errors = metrics.error_lines(sample.log_lines(spark, d))
    return metrics.counters(metrics.samples(errors, "ts", "ErrorCount",
                                            service=F.col("service")))


def latest_error_lines(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest_errors(sample.log_lines(spark, d)).select(
        "event_id", "ts", "level", "service", "message")


def _hourly_alarm(spark: SparkSession, d: str, statistic: str, threshold: float) -> DataFrame:
    rows = metrics.period_statistic(sample.log_lines(spark, d), "duration_ms", ["service"],
                                    statistic, "1 hour")
    return metrics.threshold_alarm(rows, ["service"], threshold, step="1 hour")


def alarm_average(spark: SparkSession, d: str) -> DataFrame:
    return _hourly_alarm(spark, d, "average", AVERAGE_MS)


def alarm_p99(spark: SparkSession, d: str) -> DataFrame:
    return _hourly_alarm(spark, d, "p99", P99_MS)


def alarm_sum(spark: SparkSession, d: str) -> DataFrame:
    return _hourly_alarm(spark, d, "sum", SUM_MS)


def alarm_two_minutes(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.period_statistic(sample.log_lines(spark, d), "duration_ms", ["service"], "sum")
    return metrics.threshold_alarm(rows, ["service"], 200.0, missing="missing")


def alarm_composite(spark: SparkSession, d: str) -> DataFrame:
    return metrics.composite_alarm([_hourly_alarm(spark, d, "average", AVERAGE_MS),
                                    _hourly_alarm(spark, d, "p99", P99_MS)])


def email_counts(spark: SparkSession, d: str) -> DataFrame:
    mails = _mails(spark, d)
    attempts = mails.withColumn("failed", F.col("event_id") % 13 == 0)
    return metrics.counters(metrics.with_common_tags(
        metrics.email_samples(attempts), NOTIFIER, ENVIRONMENT), "1 day")


# Results written and read back

def _stored(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stored_spend_cube(spark: SparkSession, d: str) -> DataFrame:
    """The backfill job's cube, read back from its partitions by date, in which carriers are sorted."""
    tables = sample.shipments(spark, d), sample.invoices(spark, d)
    root, schema = _stored(spark, "spend"), spend.spend_history(*tables).schema
    jobs.run_spend_backfill(*tables, root)
    return plain(spark.read.schema(schema).parquet(root).select(schema.names))


def stored_rates(spark: SparkSession, d: str) -> DataFrame:
    """Newest card per key after two batches, folded into a new path, and a late third, read back."""
    cards = sample.rate_history(spark, d).select(
        "carrier_id", "lane_id", "refreshed_at", "refresh_id", "rate_per_cwt")
    keys, order = rates.RATE_KEY, ["refreshed_at", "refresh_id"]
    path, folded = _stored(spark, "rates"), _stored(spark, "rates")
    day = F.col("refreshed_at")
    batches.append(cards.filter(day < "1997-01-01"), path, 0)
    batches.append(cards.filter(day >= "1999-01-01"), path, 1)
    batches.fold(spark, path, cards.schema, keys, order, folded)
    batches.append(cards.filter((day >= "1997-01-01") & (day < "1999-01-01")), folded, 2)
    table = batches.current(spark, folded, cards.schema, keys, order)
    return plain(table.select("carrier_id", "lane_id", "refresh_id", "rate_per_cwt"))


def stored_messages(spark: SparkSession, d: str) -> DataFrame:
    """Created events as messages in JSON files, read back with the fields of their bodies."""
    events = lifecycle.created_events(sample.shipments(spark, d))
    path = _stored(spark, "messages")
    events.write.json(path)
    return _created_fields(spark.read.schema(events.schema).json(path))


# Quality and retention

def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    found = quality.violations(sample.shipment_requests(spark, d),
                               quality.request_rules("create_shipment"))
    return found.filter(F.size("violations") > 0).select(
        "shipment_id", F.array_join("violations", ",").alias("violations"))


def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    legs = quality.violation_counts(sample.legs(spark, d), quality.table_rules("shipment_legs"))
    orders = quality.violation_counts(sample.shipments(spark, d),
                                      quality.table_rules("shipments"))
    asked = quality.violation_counts(sample.shipments(spark, d),
                                     quality.request_rules("update_status"))
    taken = quality.violation_counts(sample.incoming_invoices(spark, d),
                                     quality.request_rules("receive_invoice"))
    stacked = [df.withColumn("table", F.lit(name)) for name, df in (
        ("legs", legs), ("shipments", orders), ("status_requests", asked),
        ("invoice_requests", taken))]
    total = stacked[0]
    for more in stacked[1:]:
        total = total.unionByName(more)
    return total


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(sample.incoming_invoices(spark, d), ["invoice_number"])


def orphan_children(spark: SparkSession, d: str) -> DataFrame:
    parents = sample.shipments(spark, d).filter(F.col("status") != "CANCELLED")
    return quality.orphans(sample.legs(spark, d), parents, "shipment_id").select(
        "shipment_id", "sequence")


def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = upsert.retained(sample.tracking_events(spark, d), "ts", "2024-04-10 00:00:00")
    return kept.select("event_id", "ts")


def partial_upsert(spark: SparkSession, d: str) -> DataFrame:
    return document_index(spark, d).select(
        "document_id", "shipment_id", "status", "uploaded_by", "description", "indexed_at")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    freight_spend_daily, freight_spend_by_shipment_grain, freight_spend_one_day,
    carrier_scorecard, carrier_scorecard_all_time,
    report_spend_all, report_spend_carrier, report_performance, report_spend_as_text, adhoc_sql,
    shipment_search, shipment_search_page, shipment_page_after, page_totals, shipper_history,
    invoice_listing, carrier_invoices, overdue_shipments, overdue_invoices, status_counts_since,
    invoice_with_lines, shipment_with_legs,
    multi_carrier_quote, best_quote, ranked_quotes, rate_lookup, weight_buckets, rate_changes,
    latest_rate_per_key, rate_upsert, rate_valid_on_date, rate_fallback,
    rate_refresh_counts, rate_event_messages,
    three_way_match, contract_match, match_on_delivery, invoice_events, discrepancy_flags,
    invoice_intake, intake_line_items, duplicate_invoices, line_rollup, manual_approval,
    approval_events, undecided_invoices,
    paid_invoices,
    webhook_intake, webhook_outcomes, tracking_messages, message_types, quarantine,
    event_routing, event_dedup, status_mapping, known_and_unknown_shipments,
    lifecycle_fold, lifecycle_fold_sliced, lifecycle_final_status, delivery_events,
    status_changed_events, carrier_assignment, created_events, delivery_variance,
    reference_numbers,
    stream_lifecycle, stream_error_counts,
    document_key_parse, document_batch_counts, document_index, document_register,
    documents_of_shipment, document_delete, ocr_jobs, ocr_batch_counts, ocr_job_documents,
    notification_outbox, display_values, places_and_lanes,
    metric_counts_per_window, duration_timers, error_counts, latest_error_lines,
    alarm_average, alarm_p99, alarm_sum, alarm_two_minutes, alarm_composite, email_counts,
    quality_violations, quality_counts, duplicate_keys, orphan_children, retention_filter,
    partial_upsert, stored_spend_cube, stored_rates, stored_messages,
)}
QUERIES |= live.QUERIES
