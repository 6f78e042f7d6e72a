"""Queries over what streams and stored results leave behind; part of the catalogue."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import (lifecycle, metrics, numbering, partials, quality, ranked_pages, search,
                                tracking, trigrams)
from lanewise.plans import jobs
from lanewise.session import shared_dir
from lanewise.sources import results, sample
from lanewise.streaming import alarms, arrivals, ordered, pipeline, redelivery


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select([F.col(f.name).cast("double" if f.dataType.typeName() == "decimal" else f.dataType)
                      .alias(f.name) for f in df.schema])


CLOSING = "2100-01-01 00:00:00"
LATENESS, WAIT = "21 days", "10 days"


def _delivered(rows: DataFrame, number: str | None, closing: DataFrame) -> DataFrame:
    """A stream that hands ``rows`` over in batches, by the value of ``number``, then a closing row that
    moves the watermark past all of them."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/delivery-{uuid4().hex}"
    batches = [rows]
    if number:
        # Made once, by all tasks; a batch then is a copy of its own files.
        rows.write.partitionBy(number).parquet(f"{root}-rows")
        rows = spark.read.schema(rows.schema).parquet(f"{root}-rows")
        last = rows.agg(F.max(number)).first()[0]
        batches = [rows.filter(F.col(number) == n).drop(number) for n in range((last or 0) + 1)]
    for i, batch in enumerate([*batches, closing]):
        batch.coalesce(1).write.parquet(f"{root}/batch={i:04d}")
    return (spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{root}/batch=*"))


def _stores(spark: SparkSession) -> int:
    """State stores of a stream: one per core, eight at least."""
    return max(8, spark.sparkContext.defaultParallelism)


def _closing(like: DataFrame, ts: str, name: str = "-1") -> DataFrame:
    row = like.sparkSession.range(1)
    return row.select(*[
        (F.lit(CLOSING) if f.name == ts else F.lit(name) if f.dataType.simpleString() == "string"
         else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def shuffled_requests(spark: SparkSession, d: str) -> DataFrame:
    """Status requests with the number of the delivery they come in: their week, up to two weeks later,
    and every 97th not before the end."""
    requests = tracking.status_requests(tracking.once(sample.tracking_events(spark, d)))
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    held_back = F.when(F.col("event_id") % 97 == 0, 6).otherwise((F.col("event_id") % 3).cast("int"))
    return requests.select("shipment_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
                           "requested_status", F.lit(lifecycle.DEFAULT_START).alias("start_status"),
                           F.greatest(week + held_back, F.lit(0)).alias("delivery"))


def lifecycle_in_event_time(spark: SparkSession, d: str) -> DataFrame:
    """The life cycle of requests that come in out of order, judged when the watermark has passed."""
    requests = shuffled_requests(spark, d)
    stream = _delivered(requests, "delivery", _closing(requests.drop("delivery"), "ts"))
    judged = pipeline.drain(ordered.replay_in_order(stream, LATENESS), _stores(spark))
    return judged.select(F.col("event_id").cast("bigint").alias("event_id"), "shipment_id",
                         F.col("ts").cast("timestamp_ntz").alias("ts"), "requested_status",
                         "old_status", "new_status", "accepted", "late")


def requests_before_shipments(spark: SparkSession, d: str) -> DataFrame:
    """Requests for stored shipments, for shipments that arrive within ten days, and for unknown ones."""
    requests = shuffled_requests(spark, d).drop("delivery", "start_status")
    shipments = sample.shipments(spark, d).select("shipment_id", "status")
    stored = shipments.filter(F.col("shipment_id").cast("bigint") % 4 != 0).select("shipment_id")
    came = shipments.filter(F.col("shipment_id").cast("bigint") % 4 == 0).select(
        "shipment_id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
            hours=(F.col("shipment_id").cast("bigint") * 7 % 720).cast("int"))).alias("arrived_at"))
    met = arrivals.with_arrivals(
        _delivered(requests, None, _closing(requests, "ts")), stored,
        _delivered(came, None, _closing(came, "arrived_at", "-2")), WAIT, "30 days")
    found = pipeline.drain(met.select("event_id", "shipment_id", "known", "arrived_at"), 8)
    return found.withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))


def message_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every receive of every message and where it went: some fail for good, some once, some twice."""
    queue = sample.queue_messages(spark, d).select(
        F.col("event_id").cast("string").alias("message_id"), "body")

    def handled(received: DataFrame) -> DataFrame:
        read = tracking.with_event_type(received)
        number = F.col("message_id").cast("bigint")
        busy = F.when(number % 77 == 0, 2).when(number % 7 == 0, 1).otherwise(0)
        return read.select("message_id", "body",
                           (F.col("readable") & (F.col("attempt") >= busy)).alias("handled"))

    return redelivery.drained(queue, handled, partitions=_stores(spark))


def _months(days: DataFrame, path: str) -> DataFrame:
    """Daily partials stored by month, read back."""
    stored = days.withColumn("month", F.date_format("day", "yyyy-MM"))
    results.write_partitions(stored, path, ["month"])
    return days.sparkSession.read.schema(stored.schema).parquet(path)


def _partials(spark: SparkSession, d: str, sketch: bool) -> list[DataFrame]:
    shipments, root = sample.shipments(spark, d), f"{shared_dir(spark)}/partials-{uuid4().hex}"
    return [_months(partials.shipment_days(shipments, sketch), f"{root}/shipments"),
            _months(partials.invoice_days(sample.invoices(spark, d)), f"{root}/invoices"),
            _months(partials.lane_days(shipments), f"{root}/lanes")]


def scorecard_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The rolling scorecard from stored daily partials."""
    found = partials.rolling_scorecard(*_partials(spark, d, False), "1998-06-30")
    return _plain(found)


def lanes_from_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Lanes per carrier over all days, exact and by merged sketches, and whether they agree within
    the sketch's error."""
    shipments, invoices, lanes = _partials(spark, d, True)
    window = ("2001-12-31", 3000)
    exact = partials.rolling_scorecard(shipments, invoices, lanes, *window)
    rough = partials.rolling_scorecard(shipments, invoices, None, *window).select(
        "carrier_id", "carrier_name", F.col("distinct_lanes_served").alias("estimate"))
    close = (F.abs(F.col("estimate") - F.col("distinct_lanes_served"))
             <= F.ceil(partials.SKETCH_ERROR * F.col("distinct_lanes_served")))
    return exact.join(rough, partials.CARRIER).select(
        "carrier_id", "distinct_lanes_served", close.alias("within_error"))


def numbers_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Reference numbers given out in three batches, the second one twice."""
    shipments = sample.shipments(spark, d)
    path = f"{shared_dir(spark)}/numbers-{uuid4().hex}"
    schema = "shipment_id string, day date, place bigint, reference_number string, batch int"
    batch = F.col("shipment_id").cast("bigint") % 3
    for i, n in enumerate((0, 1, 1, 2)):
        issued = (spark.read.schema(schema).parquet(path) if i else spark.createDataFrame([], schema))
        given = numbering.next_numbers(shipments.filter(batch == n), issued.drop("batch"), "SH")
        results.write_partition(given, path, {"batch": str(i)})
    return spark.read.schema(schema).parquet(path).select("shipment_id", "reference_number")


def stored_page(spark: SparkSession, d: str) -> DataFrame:
    """A deep page of all shipments, read from a stored order."""
    path = f"{shared_dir(spark)}/pages-{uuid4().hex}"
    ranked_pages.store_order(search.shipment_view(sample.shipments(spark, d)), "shipment_id", path, 16)
    found = ranked_pages.stored_page(spark, path, "shipment_id", number=130, size=100)
    return _plain(found)


def search_by_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Invoices whose number contains a text with a wildcard, found by stored trigrams."""
    path = f"{shared_dir(spark)}/trigrams-{uuid4().hex}"
    trigrams.store(sample.invoices(spark, d).select("invoice_id", "invoice_number", "status"),
                   "invoice_number", path)
    return trigrams.search(spark, path, invoice_number="INV-12_4-")


def registered_spend_day(spark: SparkSession, d: str) -> DataFrame:
    """A day's cube as the catalog has it after the job ran for all carriers and again for every second
    one: a rerun drops the partitions that it no longer writes."""
    shipments, invoices = sample.shipments(spark, d), sample.invoices(spark, d)
    name = f"spend_{uuid4().hex}"
    root = f"{shared_dir(spark)}/{name}"
    fewer = shipments.filter(F.col("carrier_id").cast("bigint") % 2 == 0)
    for rows in (shipments, fewer):
        jobs.run_daily_spend(spark, rows, invoices, root, "1998-03-15", name)
    return _plain(spark.table(name).drop("date"))


ALARMS = {"average": alarms.Alarm("average", 500.0), "p99": alarms.Alarm("p99", 2000.0),
          "sum": alarms.Alarm("sum", 2500.0)}


def _alarms(spark: SparkSession, d: str, asked: dict[str, alarms.Alarm]) -> DataFrame:
    """Hourly alarms over log lines that come in week by week."""
    logs = sample.log_lines(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "service",
                                             "duration_ms")
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    # A null would be left out, and with it the time that moves the watermark.
    closing = _closing(logs, "ts").withColumn("duration_ms", F.lit(0).cast("bigint"))
    stream = _delivered(logs.withColumn("week", F.greatest(week, F.lit(0))), "week", closing)
    told = alarms.live_alarms(stream, "duration_ms", ["service"], asked, "1 hour", "1 hour")
    return pipeline.drain(told, 8).withColumn("period_start",
                                              F.col("period_start").cast("timestamp_ntz"))


def live_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Three alarms per service, with the first hour without data after each hour with data."""
    return _alarms(spark, d, ALARMS)


def live_composite_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Hours in which one of two live alarms of some service is on, gaps included."""
    return metrics.composite_alarm([_alarms(spark, d, {n: ALARMS[n] for n in ("average", "p99")})])


def matches_one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """Every invoice of shipments that are delivered on a stream; some hold amounts that are none."""
    number = F.col("shipment_id").cast("bigint")
    invoices = sample.invoices(spark, d).withColumns({
        "invoiced_amount": F.when(number % 41 == 0, "n/a").otherwise(
            F.col("invoiced_amount").cast("string")),
        "expected_amount": F.when(number % 43 == 0, "USD 12").otherwise(
            F.col("expected_amount").cast("string"))})
    delivered = sample.shipments(spark, d).filter(F.col("status") == "DELIVERED").select("shipment_id")
    root = f"{shared_dir(spark)}/matches-{uuid4().hex}"
    # A stored table, as in the real thing: what makes it up is not done again for every batch.
    invoices.write.parquet(f"{root}/invoices")
    invoices = spark.read.schema(invoices.schema).parquet(f"{root}/invoices")
    delivered.repartition(4).write.parquet(f"{root}/in")
    stream = (spark.readStream.schema(delivered.schema).option("maxFilesPerTrigger", 2)
              .parquet(f"{root}/in"))
    pipeline.match_each(stream, invoices, root, f"{root}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    keys = "invoice_id string, shipment_id string"
    matched = spark.read.schema(
        f"{keys}, status string, match_outcome string, match_reason string").parquet(f"{root}/matched")
    failed = spark.read.schema(f"{keys}, error string").parquet(f"{root}/failed")
    return matched.drop("batch").unionByName(failed.drop("batch"), allowMissingColumns=True)


def stored_table_audit(spark: SparkSession, d: str) -> DataFrame:
    """All rules of the four stored tables over rows of which some were damaged."""
    def every(n: int, name: str, damaged: Column, key: str = "shipment_id") -> Column:
        number = F.regexp_extract(key, r"^(\d+)", 1).cast("bigint")
        return F.when(number % n == 0, damaged).otherwise(F.col(name))

    nothing = F.lit(None).cast("string")
    shipments, legs = sample.shipments(spark, d), sample.legs(spark, d)
    invoices, lines = sample.invoices(spark, d), sample.line_items(spark, d)
    number = F.col("shipment_id").cast("bigint")
    shipments = shipments.filter(number % 101 != 0).withColumns({
        "reference_no": every(10, "reference_no", F.concat(F.lit("REF-"), (number % 100).cast("string"))),
        "dest_city": every(13, "dest_city", nothing)})
    legs = legs.unionByName(legs.filter(number % 7 == 0))
    invoices = invoices.filter(number % 97 != 0).withColumns({
        "currency": every(11, "currency", nothing), "status": every(17, "status", F.lit("LOST"))})
    lines = lines.withColumns({"description": every(19, "description", nothing, "invoice_id")})
    return quality.audit({"shipments": shipments, "shipment_legs": legs, "invoices": invoices,
                          "invoice_line_items": lines})


QUERIES = {f.__name__: f for f in (
    lifecycle_in_event_time, requests_before_shipments, message_attempts, scorecard_from_days,
    lanes_from_sketches, numbers_in_batches, stored_page, search_by_trigrams,
    registered_spend_day, live_alarms, live_composite_alarm, matches_one_by_one,
    stored_table_audit)}
