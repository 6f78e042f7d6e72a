"""Streams give what the batch operators give on the same input."""

import json

from pyspark.sql import functions as F

from lanewise.operators import lifecycle, metrics, tracking
from lanewise.plans import catalogue
from lanewise.sources import messages, sample
from lanewise.streaming import pipeline, state


def run(query_writer):
    query = query_writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_state_equals_fold(spark, sf_small, tmp_path):
    events = sample.tracking_events(spark, sf_small).withColumn("ts", F.col("ts").cast("timestamp"))
    requests = tracking.status_requests(events).withColumn(
        "start_status", F.lit("CARRIER_ASSIGNED"))
    # Three files in time order, one per micro-batch.
    src = str(tmp_path / "in")
    for i in range(3):
        requests.filter(F.floor(F.dayofmonth("ts") / 11) == i).coalesce(1).write.mode(
            "append").parquet(f"{src}/part={i}")
    stream = (spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1)
              .parquet(src + "/part=*"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run(messages.append_stream(state.replay_stream(stream), out, ck))
    columns = ["shipment_id", "event_id", "old_status", "new_status", "accepted"]
    streamed = spark.read.parquet(out).select(columns)
    folded = lifecycle.replay(requests).select(columns)
    assert streamed.count() == requests.count() > 0
    assert streamed.exceptAll(folded).isEmpty() and folded.exceptAll(streamed).isEmpty()


def test_pipeline_from_messages(spark, sf_small, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    codes = ["PACKAGE_RECEIVED", "in_transit", "OUT_FOR_DELIVERY", "LABEL_PRINTED", "DELIVERED",
             "DELIVERED"]
    lines = []
    for i, code in enumerate(codes):
        body = {"shipmentId": "5", "carrierStatus": code, "statusDescription": "x",
                "location": "Hub", "correlationId": f"c{i}",
                "timestamp": f"2024-01-01T00:0{i}:00Z"}
        inner = json.dumps(body)
        wrapped = json.dumps({"Type": "Notification", "Message": inner}, separators=(",", ":"))
        lines += [wrapped if i % 2 else inner] * (2 if i == 1 else 1)
    lines += ["not json", json.dumps({"shipmentId": "nobody", "carrierStatus": "PICKED_UP",
                                      "correlationId": "c9",
                                      "timestamp": "2024-01-01T00:00:00Z"})]
    (src / "a.txt").write_text("\n".join(lines))
    shipments = sample.shipments(spark, sf_small).withColumn("status", F.lit("CARRIER_ASSIGNED"))
    queue = messages.text_stream(spark, str(src))
    judged = pipeline.judged_requests(pipeline.tracking_requests(queue), shipments)
    root = str(tmp_path / "out")
    run(pipeline.fan_out(judged, root, str(tmp_path / "ck")))
    changed = spark.read.parquet(f"{root}/status_changed")
    assert [(r.old_status, r.new_status) for r in changed.orderBy("occurred_at").collect()] == [
        ("CARRIER_ASSIGNED", "PICKED_UP"), ("PICKED_UP", "IN_TRANSIT"),
        ("IN_TRANSIT", "OUT_FOR_DELIVERY")]
    assert spark.read.parquet(f"{root}/delivered").count() == 1
    rejected = spark.read.parquet(f"{root}/rejected").collect()
    assert [(r.old_status, r.requested_status) for r in rejected] == [("DELIVERED", "DELIVERED")]
    unknown = spark.read.parquet(f"{root}/unknown").collect()
    assert [(r.shipment_id, r.requested_status) for r in unknown] == [("nobody", "PICKED_UP")]
    later = str(tmp_path / "later")
    pipeline.fold_states(spark, root, later)
    for place in (root, later):
        states = pipeline.states(spark, place).collect()
        assert [(r.shipment_id, r.status) for r in states] == [("5", "DELIVERED")]
    pipeline.fold_states(spark, root, later, "ts > timestamp '2024-02-01 00:00:00'")
    assert pipeline.states(spark, later).isEmpty()
    run(pipeline.quarantine(messages.text_stream(spark, str(src)), root, str(tmp_path / "qk")))
    assert [r.body for r in spark.read.parquet(f"{root}/unreadable").collect()] == ["not json"]
    bad = messages.unreadable(messages.parse(spark.read.text(str(src)).withColumnRenamed(
        "value", "body"), "shipmentId string"))
    assert [r.body for r in bad.collect()] == ["not json"]


def test_requests_without_id_all_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"shipmentId": str(i), "carrierStatus": "PICKED_UP",
                         "timestamp": "2024-01-01T00:00:00Z"}) for i in range(5)]
    lines += [json.dumps({"shipmentId": "9", "carrierStatus": "PICKED_UP", "correlationId": "c",
                          "timestamp": "2024-01-01T00:00:00Z"})] * 3
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    requests = pipeline.tracking_requests(messages.text_stream(spark, str(tmp_path / "in")))
    found = pipeline.drain(requests).collect()
    assert sorted(r.shipment_id for r in found) == ["0", "1", "2", "3", "4", "9"]
    batch = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 3)], "event_id string, n int")
    assert tracking.once(batch).count() == 3


def test_live_counters_equal_batch(spark, sf_small, tmp_path):
    logs = sample.log_lines(spark, sf_small).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    logs.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src)
    out = str(tmp_path / "out")
    samples = metrics.samples(metrics.error_lines(stream), "ts", "ErrorCount",
                              service=F.col("service"))
    run(messages.append_stream(pipeline.live_counters(samples), out, str(tmp_path / "ck")))
    live = spark.read.schema("period_start timestamp, metric string, tags string, value bigint"
                             ).parquet(out)
    batch = metrics.counters(metrics.samples(metrics.error_lines(logs), "ts", "ErrorCount",
                                             service=F.col("service")))
    # Windows the watermark has not passed yet are still open.
    closed = batch.filter(F.col("period_start") < live.agg(F.max("period_start")).first()[0])
    assert live.count() >= closed.count() > 100
    assert live.exceptAll(batch).isEmpty() and closed.exceptAll(live).isEmpty()


def test_delivered_stream_meets_invoices(spark, sf_small, tmp_path):
    shipments = sample.shipments(spark, sf_small).filter("status = 'DELIVERED'").select("shipment_id")
    src = str(tmp_path / "in")
    shipments.write.parquet(src)
    stream = spark.readStream.schema(shipments.schema).parquet(src)
    matched = pipeline.matches_on_delivery(stream, sample.invoices(spark, sf_small))
    out = str(tmp_path / "out")
    run(messages.append_stream(matched, out, str(tmp_path / "ck")))
    live = (spark.read.parquet(out).groupBy("match_outcome", "match_reason")
            .agg(F.count(F.lit(1)).alias("invoices")))
    batch = catalogue.match_on_delivery(spark, sf_small)
    assert live.exceptAll(batch).isEmpty() and batch.exceptAll(live).isEmpty()


def test_message_attributes(spark):
    rows = spark.createDataFrame([("s1", None), ("s2", "c")], "shipment_id string, cid string")
    sent = messages.to_messages(rows, ["shipment_id"], F.lit("ShipmentCreatedEvent"),
                                F.col("cid")).orderBy("value").collect()
    assert [r.correlation_id for r in sent] == ["unknown", "c"]
    assert json.loads(sent[0].value) == {"eventType": "ShipmentCreatedEvent", "shipment_id": "s1"}
    assert sent[0].subject == sent[0].event_type == "ShipmentCreatedEvent"
