"""Jobs, sinks and keyed batches: same result again, nothing lost, right dates."""

import os
import subprocess
import sys
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lanewise.functions import timing
from lanewise.operators import matching, metrics, quality, rates, reports, scorecard, spend, upsert
from lanewise.plans import jobs
from lanewise.sources import batches, results, sample, tables


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def inputs(spark, sf_small):
    return (sample.shipments(spark, sf_small).persist(),
            sample.invoices(spark, sf_small).persist())


def test_daily_runs_make_the_history(spark, inputs):
    history = spend.spend_history(*inputs).persist()
    days = [r[0] for r in history.select("shipment_date").distinct().orderBy(
        "shipment_date").limit(4).collect()]
    for day in days:
        daily = spend.daily_spend(*inputs, day)
        assert same(history.filter(F.col("shipment_date") == F.lit(day)), daily)


def test_spend_job_again(spark, inputs, tmp_path):
    root, day = str(tmp_path / "spend"), date(1998, 3, 15)
    day = spend.spend_history(*inputs).agg(F.max("shipment_date")).first()[0]
    for _ in range(2):
        path = jobs.run_daily_spend(spark, *inputs, root, day, table="spend_daily")
    assert path.endswith(f"/date={day}")
    cube = spend.daily_spend(*inputs, day)
    read = spark.table("spend_daily").withColumn("shipment_date", F.col("shipment_date"))
    assert read.count() == cube.count() > 0
    assert same(cube, read.drop("date"))
    assert {r.partition.split("/")[0] for r in spark.sql("SHOW PARTITIONS spend_daily").collect()} \
        == {f"date={day}"}


def test_backfill_has_the_daily_layout(spark, inputs, tmp_path):
    root = str(tmp_path / "spend")
    some = inputs[0].filter(F.col("created_at") < "1995-02-01")
    for _ in range(2):
        jobs.run_spend_backfill(some, inputs[1], root)
    read = spark.read.parquet(root)
    assert read.count() == spend.spend_history(some, inputs[1]).count() > 0
    assert {"date", "carrier_id"} <= set(read.columns)


def test_scorecard_job_again(spark, inputs, tmp_path):
    root = str(tmp_path / "scores")
    for _ in range(2):
        path = jobs.run_scorecard(spark, *inputs, root, "1998-06-30", 300, table="scores")
    assert path.endswith("/date=1998-06-30/lookback=300d")
    assert same(scorecard.carrier_scorecard(*inputs, "1998-06-30", 300),
                spark.table("scores").drop("date", "lookback"))


SHIPMENT = ("shipment_id string, carrier_id string, carrier_name string, origin_state string, "
            "dest_state string, weight_lbs decimal(10,2), negotiated_rate decimal(10,2), "
            "status string, created_at timestamp, estimated_delivery timestamp, "
            "actual_delivery timestamp")
INVOICE = ("invoice_id string, invoice_number string, shipment_id string, carrier_id string, "
           "carrier_name string, gl_code string, invoiced_amount decimal(12,2), "
           "approved_amount decimal(12,2), status string, auto_approved boolean, "
           "created_at timestamp")


def shipment(key, created, name="One", status="DELIVERED", late_hours=0, carrier="c1"):
    due = datetime(2024, 7, 1, 10)
    done = datetime(2024, 7, 1, 10 + late_hours) if status == "DELIVERED" else None
    return (key, carrier, name, "TX", "CA", D(100), D(50), status, created, due, done)


def invoice(key, ship, created, status="APPROVED", amount=10, carrier="c1"):
    return (key, f"N{key}", ship, carrier, "One", "GL", D(amount), D(amount), status,
            status == "APPROVED", created)


def test_window_counts_both_ends(spark):
    assert timing.scorecard_window("2024-01-31", 30) == (date(2024, 1, 1), date(2024, 1, 31))
    at = [datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 59),
          datetime(2024, 2, 1)]
    ships = spark.createDataFrame([shipment(str(i), t) for i, t in enumerate(at)], SHIPMENT)
    invs = spark.createDataFrame([invoice(str(i), str(i), t) for i, t in enumerate(at)], INVOICE)
    row = scorecard.carrier_scorecard(ships, invs, "2024-01-31").first()
    assert (row.total_shipments, row.total_invoices) == (2, 2)


def test_scorecard_rules(spark):
    at = datetime(2024, 1, 20)
    ships = spark.createDataFrame(
        [shipment("1", at), shipment("2", at, late_hours=5), shipment("3", at, name="Renamed"),
         shipment("4", at, status="IN_TRANSIT"), shipment("5", at, status="CREATED"),
         shipment("6", at, carrier="c2")], SHIPMENT)
    invs = spark.createDataFrame(
        [invoice("1", "1", at), invoice("2", "1", at, "DISPUTED"), invoice("3", None, at)], INVOICE)
    got = {(r.carrier_id, r.carrier_name): r
           for r in scorecard.carrier_scorecard(ships, invs, "2024-01-31").collect()}
    one, renamed, two = got["c1", "One"], got["c1", "Renamed"], got["c2", "One"]
    # Same day but later counts as on time; a shipment on the road counts as late.
    assert (one.total_shipments, one.on_time_deliveries) == (3, 2)
    assert one.on_time_rate_pct == D("66.67") and one.dispute_rate_pct == D("50.00")
    # A renamed carrier sees the invoices of its id again; a NULL shipment does not count.
    assert one.total_invoices == renamed.total_invoices == 2
    assert one.total_invoiced_amount == D(30)
    assert two.dispute_rate_pct == 0 and two.total_invoices is None and two.cost_per_lb is None
    assert (two.overall_score, two.carrier_tier) == (D("100.0"), "PREFERRED")
    assert (one.overall_score, one.carrier_tier) == (D("60.0"), "WATCH")


def test_fan_out_and_grain(spark):
    at = datetime(2024, 1, 20)
    ships = spark.createDataFrame(
        [("s0", *shipment("s0", at)[1:]), shipment("s1", at), shipment("s3", at)], SHIPMENT)
    ships = ships.withColumns({"reference_no": F.lit("r"), "shipper_id": F.lit("x"),
                               "gl_code": F.lit("GL")})
    invs = spark.createDataFrame(
        [invoice("a", "s1", at), invoice("b", "s3", at), invoice("c", "s3", at, "DISPUTED"),
         invoice("d", "s3", at), invoice("e", "gone", at), invoice("f", None, at)], INVOICE)
    per_invoice = spend.spend_history(ships, invs).first()
    assert (per_invoice.shipment_count, per_invoice.total_weight_lbs) == (5, D(500))
    assert (per_invoice.total_invoiced_amount, per_invoice.disputed_count,
            per_invoice.auto_approved_count) == (D(40), 1, 3)
    # The same numbers as the plain join gives.
    plain = spend.daily_shipments(ships).join(spend.daily_invoices(invs), "shipment_id", "left")
    want = plain.agg(F.count("shipment_id"), F.sum("weight_lbs"), F.sum("negotiated_rate"),
                     F.avg("weight_lbs"), F.sum("approved_amount")).first()
    assert tuple(want) == (per_invoice.shipment_count, per_invoice.total_weight_lbs,
                           per_invoice.total_negotiated_rate, D(per_invoice.avg_weight_lbs),
                           per_invoice.total_invoiced_amount)
    per_shipment = spend.spend_history(ships, invs, "shipment").first()
    assert (per_shipment.shipment_count, per_shipment.total_invoiced_amount) == (3, D(40))


@pytest.mark.parametrize("days, fine", [(0, False), (1, True), (365, True), (366, False)])
def test_report_days(spark, inputs, days, fine):
    facts = reports.spend_facts(inputs[1])
    if fine:
        reports.spend_report(facts, "1998-01-01", days)
    else:
        with pytest.raises(ValueError):
            reports.spend_report(facts, "1998-01-01", days)


KEYED = "k string, at int, v string"


def keyed_rows(spark, path):
    found = batches.current(spark, path, KEYED, ["k"], ["at"]).collect()
    assert len(found) == len({r.k for r in found})
    return {r.k: r.v for r in found}


def test_batches_upsert(spark, tmp_path):
    path = str(tmp_path / "keyed")
    first = spark.createDataFrame([(f"k{i}", 1, "old") for i in range(200)] + [("k1", 0, "older")],
                                  KEYED)
    second = spark.createDataFrame([("k1", 2, "new"), ("k1", 3, "newest"), ("z", 1, "z"),
                                    ("k2", 0, "late"), ("k4", 1, "same time")], KEYED)
    assert keyed_rows(spark, path) == {}
    batches.append(first, path, 0)
    for _ in range(2):  # a batch that is repeated replaces itself
        batches.append(second, path, 1)
    got = keyed_rows(spark, path)
    assert len(got) == 201
    assert (got["k1"], got["z"], got["k2"], got["k3"]) == ("newest", "z", "old", "old")
    assert got["k4"] == "same time"
    assert spark.read.parquet(path).count() == 206


def test_a_write_that_dies_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "keyed")
    batches.append(spark.createDataFrame([("a", 1, "kept")], KEYED), path, 0)
    broken = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], KEYED).withColumn(
        "v", F.when(F.col("k") == "b", F.raise_error(F.lit("dies"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="dies"):
        batches.append(broken, path, 1)
    assert keyed_rows(spark, path) == {"a": "kept"}
    batches.append(spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], KEYED), path, 1)
    assert keyed_rows(spark, path) == {"a": "x", "b": "y"}


def test_folding_and_retention(spark, tmp_path):
    path, folded, recent = (str(tmp_path / name) for name in ("keyed", "folded", "recent"))
    for batch, rows in enumerate([[("a", 1, "a1"), ("b", 1, "b1")], [("a", 2, "a2")],
                                  [("c", 9, None)], []]):
        batches.append(spark.createDataFrame(rows, KEYED), path, batch)
    want = {"a": "a2", "b": "b1", "c": None}
    for _ in range(2):  # folding again replaces the first batch of the new path
        batches.fold(spark, path, KEYED, ["k"], ["at"], folded)
    assert keyed_rows(spark, path) == keyed_rows(spark, folded) == want
    batches.append(spark.createDataFrame([("b", 0, "late"), ("d", None, "undated")], KEYED), folded, 4)
    want["d"] = "undated"
    assert keyed_rows(spark, folded) == want and spark.read.parquet(folded).count() == 5
    # a batch that comes in the meantime is not touched by what is folded
    batches.append(spark.createDataFrame([("e", 1, "e1")], KEYED), path, 5)
    batches.fold(spark, folded, KEYED, ["k"], ["at"], recent, "at < 9")
    assert keyed_rows(spark, recent) == {"a": "a2", "b": "b1", "d": "undated"}
    assert keyed_rows(spark, folded) == want and keyed_rows(spark, path)["e"] == "e1"


def test_update_columns(spark):
    old = spark.createDataFrame([("d1", "s", "up", "me"), ("d2", "s", "up", "you")],
                                "document_id string, shipment_id string, status string, "
                                "uploaded_by string")
    new = spark.createDataFrame([("d1", "t0", "A", 1), ("d1", "t1", "B", 2), ("d3", None, "C", 1)],
                                "document_id string, shipment_id string, status string, at int")
    columns = ["shipment_id", "status"]
    once = upsert.update_columns(old, new, "document_id", columns, ["at"])
    twice = upsert.update_columns(once, new, "document_id", columns, ["at"])
    want = [("d1", "t1", "B", "me"), ("d2", "s", "up", "you"), ("d3", None, "C", None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_intake_and_rejects(spark):
    schema = "invoice_number string, at int, currency string, invoice_date date"
    day = date(2024, 1, 31)
    batch = spark.createDataFrame([("n1", 2, None, day), ("n1", 1, "CAD", day),
                                   ("n2", 1, None, day), ("n0", 1, None, day)], schema)
    known = spark.createDataFrame([("n0",)], "invoice_number string")
    got = {r.invoice_number: r for r in matching.take_in(batch, known, ["at"]).collect()}
    assert set(got) == {"n1", "n2"}
    assert (got["n1"].currency, got["n2"].currency) == ("CAD", "USD")
    assert got["n2"].payment_due_date == date(2024, 3, 1) and got["n2"].status == "RECEIVED"
    rejected = {(r.invoice_number, r.rejected, r.reason)
                for r in matching.rejected_requests(batch, known).collect()}
    assert rejected == {("n0", 1, "ALREADY_EXISTS"), ("n1", 1, "REPEATED_IN_BATCH")}


def test_fallback(spark):
    literal = rates.literal_cards(spark)
    carriers = spark.createDataFrame([("FedEx",), ("dhl",), ("nobody",)], "carrier_id string")
    fresh = literal.filter("carrier_id = 'ups'").withColumn("carrier_id", F.lit("dhl"))
    got = rates.with_fallback(carriers, fresh, literal)
    counts = {(r.carrier_id, r.card_source): r["count"]
              for r in got.groupBy("carrier_id", "card_source").count().collect()}
    assert counts == {("FedEx", "literal"): 4, ("dhl", "fresh"): 3}
    stored = rates.refreshed(got.withColumn("minimum_charge", F.lit(None).cast("string")),
                             "2024-01-01 00:00:00").first()
    assert stored.minimum_charge == 0 and stored.active
    dirty = got.withColumn("fuel_surcharge_percent", F.when(
        F.col("lane_id") != "TX-CA-LTL", F.col("fuel_surcharge_percent")).otherwise("soon"))
    dirty = dirty.filter("carrier_id = 'FedEx'")
    assert tuple(rates.refresh_counts(carriers, dirty).first()) == (3, 2, 1)
    assert rates.refreshed(dirty, "2024-01-01 00:00:00").count() == 3


def test_alarm_runs(spark):
    minutes = [0, 1, 3, 4, 5, 7]
    rows = [(datetime(2024, 1, 1, 0, m), "a", 10.0) for m in minutes]
    df = spark.createDataFrame(rows, "period_start timestamp, service string, statistic double")
    strict = metrics.threshold_alarm(df, ["service"], 10.0).orderBy("period_start").collect()
    assert [r.in_alarm for r in strict] == [False, True, False, True, True, False]
    loose = metrics.threshold_alarm(df, ["service"], 10.0, missing="missing").orderBy(
        "period_start").collect()
    assert [r.in_alarm for r in loose] == [False, True, True, True, True, True]
    calm = metrics.threshold_alarm(df, ["service"], 10.1).collect()
    assert not any(r.breaching or r.in_alarm for r in calm)


def test_quality_rules(spark):
    df = spark.createDataFrame([("NOPE", D(0), D(-1)), ("CREATED", None, None)],
                               "status string, weight_lbs decimal(10,2), "
                               "declared_value decimal(12,2)")
    names = ["shipment_id", "reference_no", "shipper_id", "shipper_name", "shipper_email",
             "origin_city", "origin_state", "dest_city", "dest_state", "created_at"]
    df = df.withColumns({n: F.lit("x") for n in names}).withColumn(
        "shipper_id", F.lit(None).cast("string"))
    got = quality.violations(df, quality.table_rules("shipments")).collect()
    assert got[0].violations == ["shipper_id_present", "status_known", "weight_positive",
                                 "declared_value_not_negative"]
    assert got[1].violations == ["shipper_id_present"]


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "shipments", date(2024, 1, 1), date(2024, 1, 31), 32,
                                  "u", "p")
    assert options["lowerBound"] == "2024-01-01 00:00:00"
    assert options["upperBound"] == "2024-02-01 00:00:00"
    assert options["partitionColumn"] == "created_at" and options["numPartitions"] == "32"
    assert options["fetchsize"] == "1000"


def test_command_line(spark, inputs, tmp_path):
    from lanewise.plans import main
    paths = [str(tmp_path / n) for n in ("shipments", "invoices", "out")]
    for df, path in zip(inputs, paths):
        df.write.parquet(path)
    main.main(["scorecard", "--shipments", paths[0], "--invoices", paths[1], "--output", paths[2],
               "--date", "1998-06-30", "--lookback-days", "300"])
    written = spark.read.parquet(paths[2]).drop("date", "lookback")
    assert same(scorecard.carrier_scorecard(*inputs, "1998-06-30", 300), written)


def test_shipped_package_serves_later_tasks(spark):
    from lanewise.session import ship
    ship(spark)
    ship(spark)
    assert spark.range(100).repartition(5).mapInPandas(lambda parts: parts, "id long").count() == 100


def test_results_do_not_depend_on_partitioning(spark, inputs):
    spread = [df.repartition(13) for df in inputs]
    assert same(spend.spend_history(*inputs), spend.spend_history(*spread))
    assert same(scorecard.carrier_scorecard(*inputs, "2001-12-31", 3000),
                scorecard.carrier_scorecard(*spread, "2001-12-31", 3000))


def test_jobs_run_from_another_folder(inputs, tmp_path, sf_small):
    """The command line as a file, from elsewhere, without the package on any path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    helped = subprocess.run([sys.executable, f"{root}/lanewise/plans/main.py", "--help"],
                            cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert helped.returncode == 0 and "scorecard" in helped.stdout
    for df, name in zip(inputs, ("shipments", "invoices")):
        df.write.parquet(str(tmp_path / name))
    job = subprocess.run(
        [sys.executable, f"{root}/lanewise/plans/main.py", "spend", "--shipments",
         str(tmp_path / "shipments"), "--invoices", str(tmp_path / "invoices"), "--output",
         str(tmp_path / "out"), "--date", "1995-03-10"],
        cwd=tmp_path, env=env | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false "
                                 "pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert job.returncode == 0, job.stderr[-2000:]
    assert os.path.isdir(tmp_path / "out")
    script = tmp_path / "stream.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lanewise.plans import catalogue
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate())
print("ROWS", catalogue.stream_lifecycle(spark, {sf_small!r}).count())
""")
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=300)
    assert "ROWS" in ran.stdout, ran.stderr[-2000:]
