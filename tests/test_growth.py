"""Work that must not grow faster than its input."""

import random
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions import pricing
from lanewise.operators import price_order, quality, rates
from lanewise.plans import jobs, live
from lanewise.sources import sample
from lanewise.streaming import pipeline


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cards(spark):
    rows = [(f"c{i}", "l", Decimal(p) if p else None, Decimal(f) if f else None, Decimal(m) if m else None)
            for i, (p, f, m) in enumerate([
                ("10.005", "12.5", "40"), ("10.005", "12.5", None), (None, None, "7.1234"), ("0", "0", None),
                ("999.9999", "300", "9999999999.9999"), ("-3", "1", "-5"), ("0.0001", None, "0.0001"),
                ("5.55", "33.3333", "-9999999999.9999"), (None, None, None)])] * 2
    return spark.createDataFrame(rows, "carrier_id string, lane_id string, rate_per_cwt decimal(10,4), "
                                       "fuel_surcharge_percent decimal(7,4), minimum_charge decimal(14,4)"
                                 ).withColumns({"carrier_name": F.upper("carrier_id"), "active": F.lit(True),
                                                "transit_days": F.lit(2)})


def requests(spark):
    weights = [None, "0", "0.5", "1.5", "333.33", "12345.67", "9999999.99", "-20"]
    return spark.createDataFrame([("l", w and Decimal(w)) for w in weights],
                                 "lane_id string, weight_lbs decimal(10,2)")


def test_quotes_in_whole_numbers_are_the_exact_ones(spark):
    got = rates.carrier_quotes(requests(spark), cards(spark)).select(
        "weight_lbs", "carrier_id", "total_rate")
    price = pricing.contract_rate(*map(F.col, ("weight_lbs", "rate_per_cwt", "fuel_surcharge_percent",
                                               "minimum_charge")))
    want = requests(spark).join(cards(spark), "lane_id").select("weight_lbs", "carrier_id",
                                                                price.alias("total_rate"))
    assert got.schema["total_rate"].dataType == want.schema["total_rate"].dataType
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "whole_cwt" in plan_of(got)  # worked out before the join


def test_cards_are_shuffled_once_and_bare(spark):
    """Where cards meet requests they come from one shuffle, and what is derived from them is made after it."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quoted = rates.carrier_quotes(requests(spark), cards(spark))
        plan = plan_of(quoted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 1
    made, shuffles = plan.index("AS whole#"), [m.start() for m in re.finditer("REPARTITION_BY_NUM", plan)]
    assert len(shuffles) == 2 and made < shuffles[1]  # the plan is printed from its end


def test_ranked_quotes_are_not_sorted_across_requests(spark):
    ranked = rates.ranked_quotes(requests(spark), cards(spark).distinct())
    assert "Window" not in plan_of(ranked)
    cheapest = Window.partitionBy("lane_id", "weight_lbs").orderBy("total_rate", "carrier_id")
    want = rates.carrier_quotes(requests(spark), cards(spark).distinct()).withColumn(
        "rank", F.row_number().over(cheapest)).select(ranked.columns)
    assert ranked.schema["rank"].dataType == want.schema["rank"].dataType
    assert ranked.exceptAll(want).isEmpty() and want.exceptAll(ranked).isEmpty()


def test_ranked_quotes_are_priced_by_the_block(spark):
    """A plain lane, a lane with prices beyond a long, one with more weights than a cut, one without cards."""
    plain = cards(spark).filter(F.col("rate_per_cwt").isNull() | F.col("rate_per_cwt").between(0, 20))
    lanes = [("plain", plain), ("hot", plain), ("l", cards(spark)), (None, plain)]
    offers = [rows.distinct().withColumn("lane_id", F.lit(lane)) for lane, rows in lanes]
    offers = offers[0].unionByName(offers[1]).unionByName(offers[2]).unionByName(offers[3])
    asked = requests(spark).withColumn("lane_id", F.explode(F.array(*map(F.lit, ("plain", "l", "none", None)))))
    many = spark.range(rates.WEIGHTS_PER_CUT * 2 + 1).select(
        F.lit("hot").alias("lane_id"), (F.col("id") / 3).cast("decimal(10,2)").alias("weight_lbs"))
    asked = asked.select("lane_id", "weight_lbs").unionByName(many)
    ranked = rates.ranked_quotes(asked, offers)
    assert "lambda" not in plan_of(ranked)  # a function that is read again for each quote
    cheapest = Window.partitionBy("lane_id", "weight_lbs").orderBy("total_rate", "carrier_id")
    price = pricing.contract_rate(*map(F.col, ("weight_lbs", "rate_per_cwt", "fuel_surcharge_percent",
                                               "minimum_charge"))).alias("total_rate")
    want = asked.distinct().join(offers, "lane_id").select("*", price).withColumn(
        "rank", F.row_number().over(cheapest)).select(ranked.columns)
    assert [f.dataType for f in ranked.schema] == [f.dataType for f in want.schema]
    ranked = ranked.cache()
    assert ranked.filter("lane_id = 'hot'").select("weight_lbs").distinct().count() > rates.WEIGHTS_PER_CUT
    assert ranked.exceptAll(want).isEmpty() and want.exceptAll(ranked).isEmpty()
    ranked.unpersist()


def test_cards_in_whole_numbers_are_priced_as_decimals():
    """Random cards against the exact form, with nulls and numbers on both sides of a long."""
    rng = random.Random(7)
    some = [None, 0, 1, 10 ** 9, 3 * 10 ** 9 + 7, 10 ** 17]
    for _ in range(200):
        n = rng.randint(1, 30)
        whole = [rng.choice(some[:rng.choice((5, 5, 6))] + [rng.randint(0, 10 ** 10)]) for _ in range(n)]
        amount = [rng.choice([None, 0, -5, 71234, 10 ** 13, rng.randint(0, 10 ** 7)]) for _ in range(n)]
        kept = price_order.Cards(pa.array(whole, pa.int64()), pa.array(amount, pa.int64()))
        cwt = [None, -3, 0, 1, rng.randint(0, 10 ** 6), 10 ** 9, 10 ** 12]
        places, prices = kept.quotes(pa.array(cwt, pa.int64()))
        for i, weight in enumerate(cwt):
            assert (places[i].tolist(), prices[i].tolist()) == kept._exact(weight)


def test_backfill_writes_a_file_per_day(spark, sf_small, tmp_path):
    shipments, invoices = sample.shipments(spark, sf_small), sample.invoices(spark, sf_small)
    some = shipments.filter(F.col("created_at") < "1995-02-01")
    jobs.run_spend_backfill(some, invoices, str(tmp_path / "spend"))
    files = [str(f.parent) for f in (tmp_path / "spend").rglob("*.parquet")]
    assert len(files) == len(set(files)) and files and not any("carrier_id=" in f for f in files)


def test_cards_are_cut_for_bins_that_are_asked_for(spark):
    card = spark.createDataFrame([("c", "l", [0, 5])], "carrier_id string, lane_id string, asked array<bigint>"
                                 ).withColumns({
        "effective_date": F.lit("1970-01-01").cast("date"), "expiration_date": F.lit(None).cast("date"),
        **{name: F.lit(1) for name in rates.CARD}})
    bins = rates.validity_bins(card, F.lit("2000-01-01").cast("date"), "asked")
    assert sorted(r.bin for r in bins.collect()) == [0, 5]


def test_deliveries_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        made.add(1)
        return n % 5

    rows = spark.range(20).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"),
                                  counted("id").alias("delivery"))
    live._delivered(rows, "delivery", live._closing(rows.drop("delivery"), "ts"))
    assert made.value == 20


def test_audit_reads_a_table_once(spark, sf_small, tmp_path):
    tables = {"shipments": sample.shipments(spark, sf_small), "shipment_legs": sample.legs(spark, sf_small),
              "invoices": sample.invoices(spark, sf_small),
              "invoice_line_items": sample.line_items(spark, sf_small)}
    for name, rows in tables.items():
        rows.limit(50).write.parquet(str(tmp_path / name))
    found = quality.audit({name: spark.read.parquet(str(tmp_path / name)) for name in tables})
    assert plan_of(found).count("FileScan") == 4


def test_invoices_of_a_stream_are_stored_once(spark, sf_small, monkeypatch):
    seen, match_each = [], pipeline.match_each

    def watched(delivered, invoices, *rest):
        seen.extend(invoices.inputFiles())
        return match_each(delivered, invoices, *rest)

    monkeypatch.setattr(pipeline, "match_each", watched)
    live.matches_one_by_one(spark, sf_small)
    assert seen and all("/matches-" in file for file in seen)
