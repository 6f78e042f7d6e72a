"""Hand-computed money rows."""

import random
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import functions as F

from lanewise.functions import pricing
from lanewise.operators import matching

QUOTES = [  # weight, rate, fuel, minimum -> charge
    ("1000", "12.50", "18.5", "250", "250.00"),
    ("2000", "12.50", "18.5", "250", "296.25"),
    ("1333.33", "12.50", "18.5", "250", "250.00"),
    ("5432.10", "12.50", "18.5", "250", "804.63"),
    (None, "12.50", "18.5", "250", "250.00"),
    ("1000", None, "18.5", "250", "250.00"),
    ("1000", None, "18.5", None, "0.00"),
    ("1000", "12.50", None, None, "125.00"),
    ("1000", "12.50", None, "125.01", "125.01"),
    # Compared before rounding: 124.9950 is below 125.00 although it would round up to it.
    ("1000", "12.4995", None, "125.00", "125.00"),
    ("1000", "12.4996", None, "124.99", "125.00"),
]


def decimal(text):
    return None if text is None else D(text)


def test_contract_rate(spark):
    rows = [(i, *map(decimal, q)) for i, q in enumerate(QUOTES)]
    df = spark.createDataFrame(rows, "i int, w decimal(10,2), r decimal(10,4), f decimal(6,2), "
                                     "m decimal(10,2), want decimal(12,2)")
    got = df.withColumn("got", pricing.contract_rate(*[F.col(c) for c in "wrfm"])).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


@pytest.mark.parametrize("invoiced, expected, percent", [
    ("100.00", "95.00", "5.26"), ("95.00", "100.00", "-5.00"), ("10.00", "0.00", "0"),
    (None, "1.00", "0"), ("1.00", None, "0"), ("100.005", "100.00", "0.01"),
])
def test_discrepancy_percent(spark, invoiced, expected, percent):
    df = spark.createDataFrame([(decimal(invoiced), decimal(expected))],
                               "i decimal(12,3), e decimal(12,2)")
    got = df.select(pricing.discrepancy_percent(F.col("i").cast("decimal(12,2)"), F.col("e")))
    assert got.first()[0] == D(percent)


MATCHES = [  # invoiced, expected, found -> outcome, reason, status, approved
    ("105.00", "100.00", True, "APPROVED", None, "APPROVED", "100.00"),
    ("105.01", "100.00", True, "DISPUTED", "OVERCHARGE", "DISPUTED", None),
    ("1020.00", "1000.00", True, "APPROVED", None, "APPROVED", "1000.00"),
    ("1020.10", "1000.00", True, "DISPUTED", "OVERCHARGE", "DISPUTED", None),
    ("979.00", "1000.00", True, "DISPUTED", "UNDERCHARGE", "DISPUTED", None),
    ("999.00", "0.00", True, "APPROVED", None, "APPROVED", "0.00"),
    ("10.00", None, True, "DISPUTED", "RATE_NOT_FOUND", "MATCHING", None),
    ("10.00", "10.00", False, "DISPUTED", "MISSING_REFERENCE", "MATCHING", None),
]


def test_three_way_match(spark):
    rows = [(str(i), decimal(a), decimal(e), found)
            for i, (a, e, found, *_) in enumerate(MATCHES)]
    df = spark.createDataFrame(rows, "invoice_id string, invoiced_amount decimal(12,2), "
                                     "expected_amount decimal(12,2), shipment_found boolean")
    df = df.withColumns({
        "carrier_id": F.lit("c9"), "shipment_reference_number": F.lit(None).cast("string"),
        "auto_approved": F.lit(False), "approved_amount": F.lit(None).cast("decimal(12,2)")})
    got = {r.invoice_id: r for r in matching.three_way_match(df).collect()}
    for i, (_, _, _, outcome, reason, status, approved) in enumerate(MATCHES):
        row = got[str(i)]
        assert (row.match_outcome, row.match_reason, row.status) == (outcome, reason, status)
        assert row.approved_amount == decimal(approved)
        assert row.auto_approved == (outcome == "APPROVED")
        assert row.dispute_reason == (reason if status == "DISPUTED" else None)
    assert got["1"].match_description == (
        "Invoice amount $105.01 differs from expected $100.00 by $5.01 (5.0%)")
    assert got["0"].match_description == "Within tolerance (diff=$5.00)"
    assert got["6"].match_description == "Could not find contracted rate for carrier c9"
    assert got["7"].match_description == "No matching shipment found for reference: null"


def test_weight_bucket(spark):
    df = spark.createDataFrame([(D("0"),), (D("49.99"),), (D("50"),), (D("149"),), (None,)],
                               "w decimal(10,2)")
    assert [r[0] for r in df.select(pricing.weight_bucket(F.col("w"))).collect()] == [
        0, 0, 50, 100, 0]


def test_exceeds(spark):
    df = spark.createDataFrame([(D("10"), D("5")), (D("10"), D("4.99")), (None, D("1"))],
                               "i decimal(12,2), e decimal(12,2)")
    got = df.select(pricing.exceeds(F.col("i"), F.col("e"), "5.00")).collect()
    assert [r[0] for r in got] == [False, True, False]


def rounded(value, places):
    return value.quantize(D(1).scaleb(-places), ROUND_HALF_UP)


def test_charges_equal_plain_decimals(spark):
    """Random cards and weights against arithmetic in Python decimals."""
    rng = random.Random(11)

    def maybe(low, high, scale):
        return None if rng.random() < 0.1 else D(rng.randint(low, high)).scaleb(-scale)

    rows = [(i, maybe(0, 10**7, 2), maybe(0, 10**5, 2), maybe(0, 5000, 2), maybe(0, 10**6, 2))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, w decimal(10,2), r decimal(10,4), f decimal(6,2), "
                                     "m decimal(10,2)")
    got = df.withColumn("got", pricing.contract_rate(*[F.col(c) for c in "wrfm"])).collect()
    for row in got:
        if row.w is None or row.r is None:
            want = row.m if row.m is not None else D(0)
        else:
            fuel = 1 + (rounded(row.f / 100, 4) if row.f is not None else D(0))
            exact = rounded(row.w / 100, 4) * row.r * fuel
            want = row.m if row.m is not None and exact < row.m else rounded(exact, 2)
        assert row.got == want, row
        assert row.m is None or row.got >= row.m


def test_percentages_equal_plain_decimals(spark):
    rng = random.Random(12)
    rows = [(D(rng.randint(1, 10**6)).scaleb(-2), D(rng.randint(1, 10**6)).scaleb(-2),
             rng.randint(0, 400), rng.randint(1, 400)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "i decimal(12,2), e decimal(12,2), part bigint, whole bigint")
    got = df.withColumns({"off": pricing.discrepancy_percent(F.col("i"), F.col("e")),
                          "share": pricing.percent_of(F.col("part"), F.col("whole"))}).collect()
    for row in got:
        assert row.off == rounded((row.i - row.e) / row.e, 4) * 100
        assert row.share == rounded(D(row.part) * 100 / row.whole, 2)
