"""Webhooks, payload shapes, envelopes, routing, mails, documents."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lanewise.functions import messages, status, text
from lanewise.operators import documents, outbox, tracking

SECRETS = {"fedex": "s3cret", "dhl": "k" * 100, "ups": ""}
REQUEST = "id int, carrier_id string, headers map<string,string>, body string"


def sign(secret, body):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def receive(spark, calls):
    rows = [(i, carrier, headers, body) for i, (carrier, headers, body) in enumerate(calls)]
    got = tracking.receive_webhooks(spark.createDataFrame(rows, REQUEST),
                                    tracking.signing_keys(spark, SECRETS)).collect()
    return [r for r in sorted(got, key=lambda r: r.id)]


def test_signatures_and_rejects(spark):
    body = json.dumps({"TrackingInfo": {"customerTrackingId": "é1"}}, ensure_ascii=False)
    dhl = json.dumps({"shipmentTrackingNumber": "t"})
    calls = [
        ("fedex", {"X-Hub-Signature-256": sign("s3cret", body)}, body),
        ("FEDEX", {"x-hub-SIGNATURE-256": sign("s3cret", body)}, body),
        ("fedex", {"x-hub-signature-256": sign("other", body)}, body),
        ("fedex", {}, body),
        ("fedex", None, body),
        ("fedex", {"x-hub-signature-256": ""}, body),
        ("ups", {"x-hub-signature-256": "sha256=junk"}, "{}"),
        ("dhl", {"x-hub-signature-256": sign("k" * 100, dhl)}, dhl),
        ("fedex", {}, ""), ("fedex", {}, None), ("fedex", {}, " \n\t "),
        ("fedex", {}, "{oops"),
        ("fedex", {"x-hub-signature-256": "sha256=junk"}, "{oops"),
        ("fedex", {}, "[1]"), ("fedex", {}, '{"TrackingInfo": "text"}'),
        (None, {}, '{"shipmentId": "g"}'),
    ]
    got = receive(spark, calls)
    assert [r.http_status for r in got] == [
        200, 200, 401, 200, 200, 200, 200, 200, 400, 400, 400, 400, 401, 500, 500, 200]
    assert got[0].shipment_id == "é1" and got[2].shipment_id is None
    assert got[-1].carrier_id == "unknown" and got[-1].shipment_id == "g"


FULL = {
    "fedex": {"TrackingInfo": {"customerTrackingId": "s", "trackingNumber": "t", "latestStatus": {
        "statusCode": "c", "description": "d",
        "scanLocation": {"city": "Reno", "stateOrProvinceCode": "NV"}}}},
    "ups": {"shipment": {"referenceNumber": "s", "package": {"trackingNumber": "t", "activity": [
        {"status": {"type": "c"}, "description": "d",
         "location": {"address": {"city": "Reno", "stateProvince": "NV"}}},
        {"status": {"type": "old"}}]}}},
    "dhl": {"shipmentTrackingNumber": "t", "customerReference": "s", "events": [
        {"status": "c", "description": "d",
         "location": {"address": {"addressLocality": "Reno", "countryCode": "NV"}}}]},
    "own": {"shipmentId": "s", "trackingNumber": "t", "status": "c", "description": "d",
            "location": "Reno, NV"},
}


def fields(row):
    return [row[c] for c in tracking.EVENT_FIELDS]


def test_payload_shapes(spark):
    full = receive(spark, [(c, {}, json.dumps(p)) for c, p in FULL.items()])
    assert [fields(r) for r in full] == [["s", "t", "c", "d", "Reno, NV"]] * 4
    bare = receive(spark, [(c, {}, "{}") for c in FULL])
    assert [fields(r) for r in bare] == [["", "", "", "", ", "]] * 3 + [[""] * 5]
    odd = receive(spark, [
        ("ups", {}, '{"shipment": {"package": {"activity": []}}}'),
        ("dhl", {}, '{"shipmentTrackingNumber": "t", "events": []}'),
        ("dhl", {}, '{"shipmentTrackingNumber": "t", "customerReference": ""}'),
        ("own", {}, '{"status": 7}')])
    assert fields(odd[0]) == ["", "", "", "", ", "]
    assert fields(odd[1])[:2] == ["t", "t"] and fields(odd[2])[:2] == ["", "t"]
    assert odd[3].carrier_status == "7"


@pytest.mark.parametrize("code, want", [
    ("PICKED_UP", "PICKED_UP"), ("package_received", "PICKED_UP"), ("In_Transit", "IN_TRANSIT"),
    ("AT_FEDEX_FACILITY", "IN_TRANSIT"), ("ON_FedEx_VEHICLE", None), ("on_fedex_vehicle", None),
    ("PACKAGE_DELIVERED", "DELIVERED"), ("UNABLE_TO_DELIVER", "EXCEPTION"), ("what", None),
    (None, None)])
def test_status_codes(spark, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(status.shipment_status(F.col("c"))).first()[0] == want


def test_envelopes_and_types(spark):
    inner = '{"eventType":"A","x":1}'
    wrapped = json.dumps({"Type": "Notification", "Message": inner}, separators=(",", ":"))
    df = spark.createDataFrame([(0, inner), (1, wrapped), (2, '{"x":1}'), (3, '{"eventType"')],
                               "id int, body string")
    got = sorted(tracking.with_event_type(df).collect(), key=lambda r: r.id)
    assert [r.body_event_type for r in got] == ["A", "A", "", ""]
    assert [r.readable for r in got] == [True, True, True, False]
    assert got[1].message == inner


def test_routing(spark):
    df = spark.createDataFrame(
        [("shipment-events", "TrackingEventReceivedEvent"), ("shipment-events", "X"),
         ("invoice-events", "TrackingEventReceivedEvent"), ("elsewhere", "X")],
        "topic string, event_type string")
    got = sorted((r.topic, r.event_type, r.queue) for r in tracking.route(df).collect())
    assert [(t[0], t[2]) for t in got if t[1] == "X"] == [
        ("shipment-events", "analytics-queue"), ("shipment-events", "notification-queue")]
    assert [q for t, e, q in got if t == "shipment-events" and e != "X"] == [
        "analytics-queue", "notification-queue", "shipment-inbound-queue"]
    assert [q for t, _, q in got if t == "invoice-events"] == [
        "invoice-processing-queue", "notification-queue"]


def mails(spark, *events):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)],
                               "id int, body string")
    return sorted(outbox.outbox(tracking.with_event_type(df), "https://x.test").collect(),
                  key=lambda r: r.id)


def test_outbox(spark):
    changed = {"eventType": "ShipmentStatusChangedEvent", "referenceNumber": "R1",
               "shipmentId": "7"}
    got = mails(
        spark,
        {"eventType": "ShipmentCreatedEvent", "referenceNumber": "R1", "shipmentId": "7",
         "shipperEmail": "a@b.c"},
        {**changed, "newStatus": "PICKED_UP"},
        {**changed, "newStatus": "OUT_FOR_DELIVERY", "shipperEmail": " ",
         "consigneeEmail": "c@d.e"},
        {"eventType": "InvoiceDisputedEvent", "invoiceNumber": "I1", "disputeReason": "OVERCHARGE",
         "discrepancyPercentage": -3.5},
        {"eventType": "CarrierRateUpdatedEvent", "carrierName": "C", "laneId": "L",
         "changePercentage": -2.0, "procurementTeamEmail": "p@q.r"},
        {"eventType": "SomethingElse"})
    assert [r.id for r in got] == [0, 2, 3, 4]
    assert got[0].subject == "Shipment R1 Created Successfully"
    assert got[0].variables["carrierName"] == "TBD"
    assert got[0].variables["trackingUrl"] == "https://x.test/shipments/7/tracking"
    assert got[1].template == "shipment-out-for-delivery" and got[1].recipients == ["c@d.e"]
    assert got[2].recipients == [] and not got[2].is_deliverable
    assert got[2].variables["discrepancyPercentage"] == "3.5"
    assert got[3].subject == "Carrier Rate Update: C — L"
    assert (got[3].variables["changePercentage"], got[3].variables["rateIncreased"]) == (
        "2.0", "false")


KEYS = [  # raw key -> outcome, type, shipment, document, extension, content type
    ("invoice/s1/d1.pdf", "INDEXED", "INVOICE", "s1", "d1", "pdf", "application/pdf"),
    ("a/b", "SKIPPED", None, None, None, "", None),
    ("a/b/c", "INDEXED", "A", "b", "c", "", "application/octet-stream"),
    ("a/b/c.tar.gz", "INDEXED", "A", "b", "c.tar", "gz", "application/octet-stream"),
    ("invoice/s1/my+file%20x.PDF", "INDEXED", "INVOICE", "s1", "my file x", "PDF",
     "application/pdf"),
    ("a/b/c.png/more", "INDEXED", "A", "b", "c", "png", "image/png"),
    ("a/b/.tiff", "INDEXED", "A", "b", "", "tiff", "image/tiff"),
    ("a/b/50%+x%zz%41.png", "INDEXED", "A", "b", "50% x%zzA", "png", "image/png"),
    ("a/b/%C3%A9.png", "INDEXED", "A", "b", "é", "png", "image/png"),
    (None, "FAILED", None, None, None, None, None),
]


def stored(spark, keys):
    rows = [(i, json.dumps({"Records": [{"s3": {"bucket": {"name": "b"},
                                                "object": {"key": k}}}]}))
            for i, k in enumerate(keys)]
    return documents.objects(spark.createDataFrame(rows, "id int, body string"))


def test_key_parse(spark):
    got = sorted(documents.parse_keys(stored(spark, [k[0] for k in KEYS])).collect(),
                 key=lambda r: r.id)
    for row, (_, outcome, kind, shipment, doc, ext, content) in zip(got, KEYS):
        assert (row.outcome, row.document_type, row.shipment_id, row.document_id,
                row.content_type) == (outcome, kind, shipment, doc, content)
        assert (row.extension or "") == (ext or "")
        assert row.file_size_bytes == 0
    counts = documents.batch_counts(documents.parse_keys(stored(spark, [k[0] for k in KEYS])))
    assert tuple(counts.first()) == (9, 1)


def test_ocr_keys(spark):
    keys = ["Invoice/s/d.PDF", "invoice/s/d.tif", "invoice/s/d.doc", "pod/s/d.pdf", "invoice/x.pdf",
            "plain.pdf"]
    got = sorted(documents.ocr_candidates(stored(spark, keys)).collect(), key=lambda r: r.id)
    assert [r.ocr_outcome for r in got] == ["STARTED", "STARTED", "SKIPPED", "SKIPPED", "STARTED",
                                            "SKIPPED"]
    assert (got[0].shipment_id, got[0].document_id) == ("s", "d")
    assert (got[4].shipment_id, got[4].document_id) == ("x.pdf", "invoice/x")
    assert (got[5].shipment_id, got[5].document_id) == ("unknown", "plain")


def test_text_helpers(spark):
    df = spark.createDataFrame([("a'b;-_9 ", "POD", "s", "d", "png", None)],
                               "id string, t string, s string, d string, e string, n string")
    got = df.select(
        text.clean_id(F.col("id")), text.object_key(*[F.col(c) for c in "tsde"]),
        text.lane(F.col("t"), F.col("n")), text.place(F.col("s"), F.col("d")),
        text.content_type(F.lit("TIF")), text.content_type(F.lit("tif"), "upload"),
        text.show_money(F.lit("2450").cast("decimal(12,2)")),
        text.show_date(F.lit("2024-03-05").cast("date")),
        text.show_percent(F.lit("16.65").cast("decimal(5,2)")),
        messages.event_type(F.lit("{}"))).first()
    assert list(got) == ["ab-_9", "pod/s/d.png", None, "s, d", "image/tiff",
                         "application/octet-stream", "$2,450.00", "Mar 5, 2024", "16.7%", ""]
