"""Hot groups give the same rows as brute force, in pieces no task has to hold whole."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from lanewise.operators import matching, rates, search, skew

START = datetime(2024, 1, 1)


def rate_rows(seed=3):
    rng = random.Random(seed)
    sizes = [("c1", "A-B-LTL", 3000), ("c1", "B-C-LTL", 900)] + [
        (f"c{i}", "A-B-LTL", rng.randint(1, 20)) for i in range(2, 30)]
    rows, n = [], 0
    for carrier, lane, size in sizes:
        for _ in range(size):
            n += 1
            rows.append((carrier, lane, START + timedelta(minutes=rng.randint(0, size)), n,
                         Decimal(rng.randint(1, 500)) / 100))
    rng.shuffle(rows)
    return rows


def test_previous_value(spark):
    rows = rate_rows()
    df = spark.createDataFrame(rows, "carrier_id string, lane_id string, refreshed_at timestamp, "
                                     "refresh_id bigint, rate_per_cwt decimal(10,2)")
    want, last = {}, {}
    for c, lane, _, n, rate in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        want[n] = last.get((c, lane))
        last[c, lane] = rate
    for unit in ("minute", "hour", "day", "year"):
        got = rates.rate_changes(df, unit).collect()
        assert {r.refresh_id: r.previous_rate for r in got} == want
        assert len(got) == len(rows)


def test_pages_are_contiguous_and_hold_every_row(spark):
    rng = random.Random(1)
    rows = [("copies", 7)] * 2500 + [("many", rng.randint(0, 10**6)) for _ in range(2500)] + [
        (f"k{i % 50}", i) for i in range(500)] + [("none", None)] * 3 + [(None, 1)]
    df = spark.createDataFrame(rows, "invoice_id string, line int")
    got = skew.pages(df, "invoice_id", ["line"], "lines", page_rows=400).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.invoice_id, r.part)):
        assert len(r.lines) <= 400
        found.setdefault(r.invoice_id, []).extend(x.line for x in r.lines)
    want = {}
    for key, line in rows:
        if key is not None:
            want.setdefault(key, []).append(line)
    assert found == {k: sorted(v, key=lambda x: (x is not None, x)) for k, v in want.items()}
    assert {r.part for r in got if r.invoice_id == "many"} == set(range(7))
    assert {r.part for r in got if r.invoice_id.startswith("k")} == {0}


def test_children_of_every_parent(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "shipment_id string")
    legs = spark.createDataFrame(
        [("a", 2, "c2"), ("a", 1, "c1"), ("x", 1, "c")],
        "shipment_id string, sequence int, carrier_id string")
    legs = legs.withColumns({"origin_city": F.lit("o"), "estimated_departure": F.lit(START),
                             "status": F.lit("CREATED")})
    got = {r.shipment_id: [leg.sequence for leg in r.legs]
           for r in search.shipment_with_legs(parents, legs).collect()}
    assert got == {"a": [1, 2], "b": []}


def test_hot_lane_is_priced_once_per_weight(spark):
    shipments = spark.createDataFrame(
        [("A", "B", "LTL", Decimal(i % 4)) for i in range(1000)],
        "origin_state string, dest_state string, shipment_type string, weight_lbs decimal(10,2)")
    assert rates.quote_requests(shipments).count() == 4


def test_best_quote_is_the_first_of_all_quotes(spark):
    rng = random.Random(2)
    cards = [(f"c{i:02d}", "n", "A-B-LTL", Decimal(rng.randint(5, 8)), Decimal(rng.randint(0, 3)),
              None if i % 5 == 0 else Decimal(rng.randint(1, 90)), 1, i % 7 != 0)
             for i in range(60)]
    df = spark.createDataFrame(cards, "carrier_id string, carrier_name string, lane_id string, "
                                      "rate_per_cwt decimal(10,2), fuel_surcharge_percent "
                                      "decimal(5,2), minimum_charge decimal(10,2), "
                                      "transit_days int, active boolean")
    requests = spark.createDataFrame([("A-B-LTL", Decimal(w)) for w in (1, 500, 1000, 1777)]
                                     + [("A-B-LTL", None)],
                                     "lane_id string, weight_lbs decimal(10,2)")
    cheapest = {}
    for r in rates.carrier_quotes(requests, df).collect():
        offer = (r.total_rate, r.carrier_id)
        cheapest[r.weight_lbs] = min(cheapest.get(r.weight_lbs, offer), offer)
    got = {r.weight_lbs: (r.total_rate, r.carrier_id)
           for r in rates.best_quotes(requests, df).collect()}
    assert got == cheapest and len(got) == 5


def test_hot_shipment_join_is_split(spark):
    """A shipment with most of the invoices: the join's big side is cut by adaptive execution."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        invoices = spark.range(200_000, numPartitions=8).select(
            F.col("id").cast("string").alias("invoice_id"),
            F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string"))
            .alias("shipment_id"),
            F.lit("c").alias("carrier_id"), F.lit("r").alias("shipment_reference_number"),
            F.col("id").cast("decimal(12,2)").alias("invoiced_amount"),
            F.lit(None).cast("decimal(12,2)").alias("expected_amount"),
            F.lit(None).cast("decimal(12,2)").alias("approved_amount"),
            F.lit(False).alias("auto_approved"))
        shipments = spark.range(100_000).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string"))
            .alias("shipment_id"),
            F.lit("c").alias("carrier_id"), F.lit("A").alias("origin_state"),
            F.lit("B").alias("dest_state"), F.lit("LTL").alias("shipment_type"),
            F.lit(Decimal(100)).cast("decimal(10,2)").alias("weight_lbs"))
        cards = spark.createDataFrame(
            [("c", "A-B-LTL", Decimal(10), Decimal(0), Decimal(1), True)],
            "carrier_id string, lane_id string, rate_per_cwt decimal(10,2), "
            "fuel_surcharge_percent decimal(5,2), minimum_charge decimal(10,2), active boolean")
        joined = matching.with_expected(invoices, shipments, cards)
        assert len(joined.collect()) == 200_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
