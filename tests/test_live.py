"""Event time, redelivery, arrivals, partial aggregates, going numbers, deep pages, interval join."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanewise.operators import (lifecycle, matching, metrics, numbering, partials, quality, ranked_pages,
                                rates, scorecard, search, trigrams)
from lanewise.plans import live
from lanewise.sources import sample
from lanewise.streaming import alarms, ordered, pipeline, redelivery

REQUESTS = ("shipment_id string, event_id string, ts timestamp, requested_status string, "
            "start_status string")


def delivered(spark, path, batches):
    """A stream of batches of (shipment, event, minute, status)."""
    for rows in batches:
        full = [(s, e, datetime(2024, 1, 1 + m // 1440, m % 1440 // 60, m % 60), w, "CARRIER_ASSIGNED")
                for s, e, m, w in rows]
        spark.createDataFrame(full, REQUESTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken in the order of their times
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_requests_go_out_marked(spark, tmp_path):
    stream = delivered(spark, str(tmp_path / "in"), [
        [("a", "2", 5, "IN_TRANSIT"), ("b", "1", 3, "PICKED_UP")],
        [("a", "1", 4, "PICKED_UP"), ("b", "3", 30, "IN_TRANSIT")],
        [("a", "9", 1, "DELIVERED"), ("a", "8", 29, "OUT_FOR_DELIVERY")],
        [("z", "0", 59, "PICKED_UP")]])
    judged = pipeline.drain(ordered.replay_in_order(stream, "10 minutes"), 2).collect()
    assert sorted((r.shipment_id, r.event_id, r.new_status, r.late) for r in judged) == [
        ("a", "1", "PICKED_UP", False), ("a", "2", "IN_TRANSIT", False),
        ("a", "8", "OUT_FOR_DELIVERY", False), ("a", "9", None, True),
        ("b", "1", "PICKED_UP", False), ("b", "3", "IN_TRANSIT", False)]


def test_status_leaves_state_after_its_time(spark, tmp_path):
    """Ten days on, a shipment whose status is kept for five begins again; one kept for ever goes on."""
    batches = [[("a", "1", 0, "PICKED_UP")], [("z", "0", 8 * 1440, "PICKED_UP")],
               [("y", "0", 9 * 1440, "PICKED_UP")], [("a", "2", 10 * 1440, "IN_TRANSIT")],
               [("z", "9", 12 * 1440, "PICKED_UP")]]
    for keep, accepted in ((5, False), (0, True)):
        stream = delivered(spark, str(tmp_path / f"in{keep}"), batches)
        judged = pipeline.drain(ordered.replay_in_order(stream, "1 minute", keep), 2)
        assert [r.accepted for r in judged.filter("event_id = '2'").collect()] == [accepted]


def test_event_time_equals_replay_when_nothing_is_late(spark, sf_small):
    requests = live.shuffled_requests(spark, sf_small)
    stream = live._delivered(requests, "delivery", live._closing(requests.drop("delivery"), "ts"))
    judged = pipeline.drain(ordered.replay_in_order(stream, "60 days"), 4).select(
        "shipment_id", "event_id", "old_status", "new_status", "accepted")
    rows = requests.withColumn("event_id", F.col("event_id").cast("string"))
    folded = lifecycle.replay(rows).select(judged.columns)
    got, want = (sorted(map(tuple, df.collect())) for df in (judged, folded))
    assert got == want and len(got) > 500


def test_dead_letters(spark):
    rows = spark.createDataFrame([("good", "1"), ("bad", "x"), ("slow", "2"), ("good", "1")],
                                 "message_id string, body string")

    def handle(received):
        fine = (F.col("body") == "1") | (F.col("body") == "2") & (F.col("attempt") >= 2)
        return received.select("message_id", "body", fine.alias("handled"))

    journal = redelivery.drained(rows, handle).collect()
    assert sorted((r.message_id, r.attempt, r.place) for r in journal) == [
        ("bad", 1, "retry"), ("bad", 2, "retry"), ("bad", 3, "dead_letter"),
        ("good", 1, "done"), ("good", 1, "done"),
        ("slow", 1, "retry"), ("slow", 2, "retry"), ("slow", 3, "done")]


def test_a_queue_brings_its_own_state_settings(spark):
    """A session that was set up without ours has another state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(key, other)
    try:
        journal = redelivery.drained(
            spark.createDataFrame([("good", "1")], "message_id string, body string"),
            lambda received: received.select("message_id", "body", F.lit(True).alias("handled")),
            partitions=2)
        assert [(r.message_id, r.attempt, r.place) for r in journal.collect()] == [("good", 1, "done")]
        assert spark.conf.get(key) == other
    finally:
        spark.conf.set(key, before)


def test_a_card_with_very_many_versions(spark):
    """Every bin of a card keeps a bounded number of rows, and the latest valid version wins."""
    versions = spark.range(50_000).select(
        F.lit("c").alias("carrier_id"), F.lit("l").alias("lane_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1000).cast("int"))
        .alias("effective_date"),
        F.when(F.col("id") % 3 > 0, F.date_add(
            F.lit("2020-01-01").cast("date"), (F.col("id") % 1000 + F.col("id") % 7).cast("int")))
        .alias("expiration_date"),
        (F.col("id") % 977).cast("decimal(10,2)").alias("rate_per_cwt"),
        F.lit(1).cast("decimal(5,2)").alias("fuel_surcharge_percent"),
        F.lit(1).cast("decimal(10,2)").alias("minimum_charge"))
    bins = rates.validity_bins(versions, F.lit("2022-12-31").cast("date"))
    assert bins.groupBy("bin").count().agg(F.max("count")).first()[0] <= rates.BIN_DAYS ** 2 / 2 + rates.BIN_DAYS
    asked = spark.range(0, 1200, 37).select(
        F.col("id").alias("request"), F.lit("c").alias("carrier_id"), F.lit("l").alias("lane_id"),
        F.date_add(F.lit("2019-12-01").cast("date"), F.col("id").cast("int")).alias("day"))
    got = rates.rates_on(versions, asked, "day", "request")
    card = F.struct("effective_date", *rates.CARD)
    want = asked.join(versions, rates.RATE_KEY).groupBy("request").agg(F.max(F.when(
        (F.col("effective_date") <= F.col("day"))
        & (F.col("expiration_date").isNull() | (F.col("expiration_date") >= F.col("day"))), card))
        .alias("card")).select("request", "card.*")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.filter("effective_date is null").count() > 0


@pytest.mark.parametrize("day, lookback", [("1998-06-30", 30), ("2001-12-31", 3000), ("1990-01-01", 9)])
def test_scorecard_from_days(spark, sf_small, tmp_path, day, lookback):
    shipments, invoices = sample.shipments(spark, sf_small), sample.invoices(spark, sf_small)
    root = str(tmp_path)
    days = [live._months(df, f"{root}/{i}") for i, df in enumerate((
        partials.shipment_days(shipments), partials.invoice_days(invoices),
        partials.lane_days(shipments)))]
    got = partials.rolling_scorecard(*days, day, lookback)
    want = scorecard.carrier_scorecard(shipments, invoices, day, lookback).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_numbers_go_on(spark):
    def batch(ids, day="2024-01-01"):
        return spark.createDataFrame([(i, datetime.fromisoformat(f"{day} 0{ord(i[-1]) % 3}:00:00"))
                                      for i in ids], "shipment_id string, created_at timestamp_ntz")

    issued = spark.createDataFrame([], "shipment_id string, day date, place bigint, "
                                       "reference_number string")
    seen = {}
    for rows in (batch("abc"), batch("bcd"), batch("bcd"), batch("efg"), batch("xy", "2024-01-02")):
        given = numbering.next_numbers(rows, issued, "SH")
        issued = issued.unionByName(spark.createDataFrame(given.collect(), issued.schema))
        now = {r.shipment_id: r.reference_number for r in issued.collect()}
        assert seen.items() <= now.items()  # given numbers stay
        seen = now
    first = sorted(n for n in seen.values() if "20240101" in n)
    assert first == [f"SH-20240101-{k:06}" for k in range(1, 8)]
    assert sorted(n for n in seen.values() if "20240102" in n) == ["SH-20240102-000001",
                                                                  "SH-20240102-000002"]


def test_deep_page_reads_its_ranges_only(spark, sf_small, tmp_path):
    rows = search.shipment_view(sample.shipments(spark, sf_small))
    path = str(tmp_path / "order")
    ranked_pages.store_order(rows, "shipment_id", path, 12)
    counts = ranked_pages.part_counts(spark, path)
    assert sum(n for _, n in counts) == rows.count()
    for number in (0, 3, 9, 10**6):
        got = ranked_pages.stored_page(spark, path, "shipment_id", number, 100, counts)
        want = search.page(rows, "shipment_id", number, 100).select(got.columns)
        assert got.collect() == want.collect()
    got = ranked_pages.stored_page(spark, path, "shipment_id", 9, 100, counts)
    chosen, _ = ranked_pages.ranges_of(counts, 9, 100)
    assert 1 <= len(chosen) <= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.split("PartitionFilters: [")[1:])
    assert ranked_pages.PART in filters.split("]")[0]


def test_receives_expire_by_the_clock_only_when_asked():
    assert redelivery.ReceiveCounter(3, None).keep_millis is None
    assert redelivery.ReceiveCounter(3, 4).keep_millis == 4 * 86_400_000


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(
        [f"Nation_{k} City {k * 37 % 101}" for k in range(3000)]
        + ["", "ab", None, "100% a\\b", "ÀÉÎ town", "aaa", "under_score"])], "id int, place string")
    path = str(tmp_path)
    trigrams.store(rows, "place", path)
    for query in ("nation_7", "TION%city 5", "a\\b", "%", "", "ab", "àéî", "aaaa", "nothing here", "r_s", "0%"):
        got = sorted(r.id for r in trigrams.search(spark, path, place=query).collect())
        want = sorted(r.id for r in rows.filter(search.contains_text(F.col("place"), query)).collect())
        assert got == want, query
    groups = trigrams.candidate_groups(spark, path, "under_score")
    assert 1 <= len(groups) < 10 and trigrams.candidate_groups(spark, path, "nothing here") == []
    assert trigrams.literal_grams("ab%cdef_gh") == ["cde", "def"]


def measured(spark, path, batches):
    """A stream of batches of (series, minute, value)."""
    schema = "ts timestamp, service string, ms bigint"
    for rows in batches:
        full = [(datetime(2024, 1, 1 + m // 1440, m % 1440 // 60, m % 60, 30), s, v) for s, m, v in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


MEASURED = [
    [("a", 0, 10), ("a", 1, 10), ("b", 0, 10), ("c", 0, None), ("c", 1, 1)],
    [("a", 2, 10), ("b", 2, 10), ("b", 1, 10), ("b", 3, 9)],        # b's minute 1 comes late, in time
    [("a", 9, 10), ("b", 9, 10), ("a", 10, 4), ("a", 10, 6)],       # gaps; a sum over two rows
    [("a", 30, 10)],
    [("a", 1, 99)],                                                 # minute 1 was told: left out
    [("z", 1000, 0)]]


def test_live_alarm_runs_and_gaps(spark, tmp_path):
    asked = {"two": alarms.Alarm("sum", 10.0), "three": alarms.Alarm("sum", 10.0, 3)}
    told = alarms.live_alarms(measured(spark, str(tmp_path / "in"), MEASURED), "ms", ["service"], asked,
                              "2 minutes").withColumn("m", F.expr("hour(period_start) * 60 + minute(period_start)"))
    rows = pipeline.drain(told, 3).collect()
    two = {(r.service, r.m): (r.statistic, r.breaching, r.in_alarm) for r in rows if r.alarm == "two"}
    assert len(two) == len([r for r in rows if r.alarm == "two"])  # every period once
    gap = (None, False, False)
    assert two == {
        ("a", 0): (10.0, True, False), ("a", 1): (10.0, True, True), ("a", 2): (10.0, True, True),
        ("a", 3): gap, ("a", 9): (10.0, True, False), ("a", 10): (10.0, True, True), ("a", 11): gap,
        ("a", 30): (10.0, True, False), ("a", 31): gap,
        ("b", 0): (10.0, True, False), ("b", 1): (10.0, True, True), ("b", 2): (10.0, True, True),
        ("b", 3): (9.0, False, False), ("b", 4): gap, ("b", 9): (10.0, True, False), ("b", 10): gap,
        ("c", 1): (1.0, False, False), ("c", 2): gap}
    assert {(r.service, r.m) for r in rows if r.alarm == "three" and r.in_alarm} == {("a", 2), ("b", 2)}


def test_live_alarm_passes_gaps_over(spark, tmp_path):
    told = alarms.live_alarms(measured(spark, str(tmp_path / "in"), MEASURED), "ms", ["service"],
                              {"two": alarms.Alarm("p99", 10.0)}, "2 minutes", missing="missing")
    got = {(r.service, r.period_start): (r.breaching, r.in_alarm)
           for r in pipeline.drain(told, 3).collect()}
    kept = [row for batch in MEASURED[:4] for row in batch if row[2] is not None]
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), s, v) for s, m, v in kept],
                                 "ts timestamp, service string, ms bigint")
    batch = metrics.threshold_alarm(metrics.period_statistic(rows, "ms", ["service"], "p99"), ["service"],
                                    10.0, missing="missing").collect()
    assert got == {(r.service, r.period_start): (r.breaching, r.in_alarm) for r in batch}
    with pytest.raises(ValueError):
        alarms.live_alarms(rows, "ms", ["service"], {}, "2 minutes", missing="breaching")


def test_three_periods_in_a_row(spark):
    values = {0: 10.0, 1: 11.0, 2: 12.0, 3: 9.0, 4: 10.0, 6: 10.0, 7: 10.0, 8: 10.0, 9: None}
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), None, v) for m, v in values.items()],
                               "period_start timestamp, service string, statistic double")

    def on(missing):
        found = metrics.threshold_alarm(df, ["service"], 10.0, 3, missing=missing).collect()
        assert len(found) == len(values)
        return sorted(r.period_start.minute for r in found if r.in_alarm)

    assert on("not_breaching") == [2, 8] and on("missing") == [2, 7, 8]


def test_one_bad_invoice_stops_only_itself(spark, tmp_path):
    delivered = spark.createDataFrame([("s",), ("s",), ("t",)], "shipment_id string")
    raw = spark.createDataFrame(
        [("1", "s", "100.00", "101"), ("2", "s", "ten", "100"), ("3", "s", "99999999999999", "x"),
         ("4", "s", None, "100"), ("5", "u", "1", "1")],
        "invoice_id string, shipment_id string, invoiced_amount string, expected_amount string"
    ).withColumns({"status": F.lit("RECEIVED"), "auto_approved": F.lit(False), "currency": F.lit("USD"),
                   "approved_amount": F.lit(None).cast("string"), "carrier_id": F.lit("c"),
                   "shipment_reference_number": F.lit("R")})
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    delivered.write.parquet(src)
    stream = spark.readStream.schema(delivered.schema).parquet(src)
    pipeline.match_each(stream, raw, root, f"{root}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    matched = spark.read.parquet(f"{root}/matched").collect()
    assert sorted((r.invoice_id, r.match_outcome, r.status) for r in matched) == [
        ("1", "APPROVED", "APPROVED"), ("4", "DISPUTED", "MATCHING")]
    failed = spark.read.parquet(f"{root}/failed").collect()
    assert sorted((r.invoice_id, r.error) for r in failed) == [
        ("2", "no amount: invoiced_amount"), ("3", "no amount: invoiced_amount,expected_amount")]
    rows = {r.invoice_id: r for r in matching.attempted(delivered.distinct(), raw).collect()}
    assert rows["2"].status == "MATCHING" and rows["2"].match_outcome is None


def test_audit_of_stored_tables(spark):
    shipments = spark.createDataFrame([("1", "R"), ("2", "R"), ("2", None)],
                                      "shipment_id string, reference_no string")
    others = {c: F.lit("x") for c in ("shipper_id", "shipper_name", "shipper_email", "origin_city",
                                      "origin_state", "dest_city", "dest_state", "created_at")}
    shipments = shipments.withColumns({**others, "status": F.lit("CREATED"), "weight_lbs": F.lit(1),
                                       "declared_value": F.lit(0)})
    legs = spark.createDataFrame([("1", 1), ("1", 1), ("1", 1), ("9", 1), (None, 2)],
                                 "shipment_id string, sequence int").withColumns(
        {"carrier_id": F.lit("c"), "origin_city": F.lit("x"), "status": F.lit("IN_TRANSIT")})
    found = quality.audit({"shipments": shipments, "shipment_legs": legs}).collect()
    assert {(r.table, r.rule): r["rows"] for r in found} == {
        ("shipments", "reference_no_present"): 1, ("shipments", "shipment_id_unique"): 1,
        ("shipments", "reference_no_unique"): 1, ("shipment_legs", "shipment_id_present"): 1,
        ("shipment_legs", "shipment_sequence_unique"): 2, ("shipment_legs", "shipment_id_exists"): 1}
    with pytest.raises(ValueError):
        quality.unique_keys("nothing")
