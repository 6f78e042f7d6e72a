"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from lanewise.functions import timing
from lanewise.operators import matching, scorecard, search, spend
from lanewise.plans.catalogue import QUERIES
from lanewise.session import sized_for
from lanewise.sources import results, sample

# The stateful stream runs a small Python step inside tasks; the other hands batches to a writer.
WITH_PYTHON = {"stream_lifecycle", "stream_error_counts"}


def plan_of(df):
    utils = df.sparkSession._jvm.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_no_cross_join_no_python(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scans_are_pruned_and_filtered(spark, sf_small, tmp_path):
    path = str(tmp_path / "shipments")
    sample.shipments(spark, sf_small).write.parquet(path)
    stored = spark.read.parquet(path)
    day = timing.as_date("1998-03-15")
    plan = plan_of(spend.daily_shipments(stored, day).groupBy("carrier_id").agg(
        F.sum("weight_lbs")))
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
    assert "EqualTo(status,DELIVERED)" in plan
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", read)) == {
        "carrier_id", "weight_lbs", "status", "created_at"}
    first, last = timing.scorecard_window("1998-06-30", 30)
    plan = plan_of(scorecard.window_shipments(stored, first, last))
    assert "In(status, [DELIVERED,IN_TRANSIT,OUT_FOR_DELIVERY])" in plan
    assert "GreaterThanOrEqual(created_at" in plan
    plan = plan_of(search.page(stored, "shipment_id", 3, 50))
    assert "TakeOrderedAndProject" in plan


def test_spend_join_meets_one_row_per_shipment(spark, sf_small):
    """Invoices are combined before they are shuffled to the join."""
    plan = plan_of(spend.spend_cube(spend.daily_shipments(sample.shipments(spark, sf_small)),
                                    spend.daily_invoices(sample.invoices(spark, sf_small))))
    assert plan.count("partial_count(1)") >= 1 and "partial_sum(copies" in plan


def test_bucketed_tables_meet_without_a_shuffle(spark, sf_small):
    results.write_bucketed(sample.shipments(spark, sf_small), "shipments_by_key", "shipment_id", 4)
    results.write_bucketed(sample.invoices(spark, sf_small), "invoices_by_key", "shipment_id", 4)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        joined = matching.with_expected(
            spark.table("invoices_by_key"), spark.table("shipments_by_key"),
            F.broadcast(sample.carrier_rates(spark, sf_small)))
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan
        assert "hashpartitioning(shipment_id" not in plan
        assert joined.count() == spark.table("invoices_by_key").count() > 0
    finally:
        spark.conf.set(threshold, before)


def test_partition_counts_follow_the_input():
    class Builder(dict):
        def config(self, key, value):
            self[key] = value
            return self

    key = "spark.sql.shuffle.partitions"
    assert sized_for(Builder(), 1 << 30)[key] == "200"
    assert sized_for(Builder(), 1 << 40)[key] == "2048"
    assert sized_for(Builder(), 100 << 40)[key] == "204800"
