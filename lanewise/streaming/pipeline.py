"""The tracking pipeline: messages in, shipment states, events, mails and rejects out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lanewise import schemas
from lanewise.operators import lifecycle, matching, metrics, tracking
from lanewise.operators.skew import latest
from lanewise.sources import batches, messages, results
from lanewise.session import ROCKSDB, delete_folder, shared_dir
from lanewise.streaming.state import replay_stream

WATERMARK = "10 minutes"
STATE_ORDER = ["ts", "event_id"]
STATES = "shipment_id string, status string, ts timestamp, event_id string"


def once(events: DataFrame) -> DataFrame:
    """Drop repeats of an event id that come within the watermark; rows without an id all stay."""
    timed = events.withWatermark("ts", WATERMARK)
    unique = timed.filter("event_id is not null").dropDuplicatesWithinWatermark(["event_id"])
    return unique.unionByName(timed.filter("event_id is null"))


def tracking_requests(queue: DataFrame) -> DataFrame:
    """Status requests from a stream of raw messages, each event once.

    The event time is the message's own, or its arrival (``received_at``, where the source tells it),
    so that a rerun gives the same; the id is the correlation id.  Repeats are dropped as long as they come within the watermark, which also bounds the state
    kept for it.
    """
    if "received_at" not in queue.columns:
        queue = queue.withColumn("received_at", F.lit(None).cast("timestamp"))
    event = messages.good(messages.parse(queue, schemas.TRACKING_MESSAGE)).select(
        "event.*", "received_at")
    rows = event.select(
        F.col("correlationId").alias("event_id"),
        F.coalesce(F.col("timestamp").try_cast("timestamp"), "received_at").alias("ts"),
        F.col("shipmentId").alias("shipment_id"), F.col("carrierStatus").alias("carrier_status"),
        F.col("statusDescription").alias("status_reason"), "location")
    return tracking.status_requests(once(rows))


def judged_requests(requests: DataFrame, shipments: DataFrame) -> DataFrame:
    """Requests with the state machine's verdict; ``known`` is false for shipments we do not have,
    whose requests are turned down and keep no state."""
    current = shipments.select(
        "shipment_id", F.col("status").alias("start_status"), "reference_no", "carrier_id",
        "carrier_name", "estimated_delivery", "shipper_email", "consignee_email",
        "declared_value", F.lit(True).alias("known"))
    joined = requests.join(current, "shipment_id", "left")
    return replay_stream(joined.withColumn("known", F.coalesce("known", F.lit(False))))


def fan_out(judged: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch to the state table, the two event tables, the rejects and the requests
    for unknown shipments: every row of the batch ends up in the states or the unknown ones.

    A batch that is repeated after a failure replaces its own files, so nothing is written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        everything = batch.persist()
        batch = everything.filter("known")
        outputs = {
            "unknown": everything.filter("not known").select(
                "shipment_id", "event_id", "ts", "requested_status"),
            "delivered": lifecycle.delivered_events(batch),
            "status_changed": lifecycle.status_changed_events(batch),
            "rejected": batch.filter(~F.col("accepted")).select(
                "shipment_id", "event_id", "ts", "old_status", "requested_status"),
        }
        for name, rows in outputs.items():
            results.write_partition(rows, f"{root}/{name}", {"batch": str(batch_id)})
        states = batch.select("shipment_id", F.col("new_status").alias("status"), *STATE_ORDER)
        batches.append(latest(states, ["shipment_id"], STATE_ORDER), f"{root}/states", batch_id)
        everything.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def states(spark: SparkSession, root: str) -> DataFrame:
    """The status of every shipment that ``fan_out`` has seen; ``fold_states`` keeps it short."""
    return batches.current(spark, f"{root}/states", STATES, ["shipment_id"], STATE_ORDER)


def fold_states(spark: SparkSession, root: str, to: str, keep: str = "true") -> None:
    """Carry the states to a new root, without those for which ``keep`` is false.

    The stream goes on there when it is started again with the same checkpoint.
    """
    batches.fold(spark, f"{root}/states", STATES, ["shipment_id"], STATE_ORDER, f"{to}/states", keep)


def quarantine(queue: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Write the raw messages that cannot be read, with the reason, beside the other outputs."""
    bad = messages.unreadable(messages.parse(queue, schemas.TRACKING_MESSAGE))
    return messages.append_stream(bad, f"{root}/unreadable", checkpoint)


def matches_on_delivery(delivered: DataFrame, invoices: DataFrame) -> DataFrame:
    """Stream of delivered shipments against the stored invoices."""
    return matching.match_on_delivery(delivered, invoices)


def match_each(delivered: DataFrame, invoices: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch's decisions to ``matched`` and the invoices that could not be decided, with
    the reason, to ``failed``: one bad invoice stops neither the others nor the stream.

    A batch that is repeated after a failure replaces its own files.  Each batch reads ``invoices`` for
    either output, so they should be a stored table; decided rows are held nowhere in between.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        told = batch.select("shipment_id").distinct()
        rows = matching.attempted(told, invoices)
        for name, some in (("matched", rows.filter("error IS NULL").drop("error")),
                           ("failed", rows.filter("error IS NOT NULL")
                            .select("invoice_id", "shipment_id", "error"))):
            results.write_partition(some, f"{root}/{name}", {"batch": str(batch_id)})

    return delivered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Settings for a stateful run: RocksDB state, and a number of state stores if one is given."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _finish(writer: DataStreamWriter, spark: SparkSession, checkpoint: str,
            partitions: int | None) -> None:
    """Run a stream over all it can read now; its own checkpoint is of no use afterwards."""
    with state_settings(spark, partitions):
        writer.option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    delete_folder(spark, checkpoint)


def drain(stream: DataFrame, partitions: int | None = None) -> DataFrame:
    """Run a stream over all it can read now and give what it wrote to the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/drain-{uuid4().hex}"
    _finish(messages.append_stream(stream, f"{root}/out", f"{root}/checkpoint"), spark,
            f"{root}/checkpoint", partitions)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_latest(stream: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Run an aggregation over all its stream can read now and give every group's last value.

    Groups are written whenever they change, so windows that the watermark has not passed when the
    input ends are there as well.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/drain-{uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        results.write_partition(batch, f"{root}/out", {"batch": str(batch_id)})

    _finish(stream.writeStream.outputMode("update").foreachBatch(write), spark,
            f"{root}/checkpoint", partitions)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int"
    changes = spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    return latest(changes, keys, ["batch"]).select(*stream.columns)


def live_counters(samples: DataFrame, step: str = metrics.METRIC_STEP) -> DataFrame:
    """Counters over a stream of samples; rows later than the watermark are left out and show up in
    the query's ``numRowsDroppedByWatermark``."""
    return metrics.counters(samples.withWatermark("ts", WATERMARK), step)
