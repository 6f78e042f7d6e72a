"""At-least-once queues: a message that fails comes again, and after three receives it is put aside."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lanewise.fixed_values import MAX_RECEIVES
from lanewise.session import shared_dir
from lanewise.sources import results
from lanewise.streaming.pipeline import state_settings

DONE, RETRY, DEAD = "done", "retry", "dead_letter"
RECEIVED = "message_id string, body string, handled boolean, attempt int, place string"


class ReceiveCounter(StatefulProcessor):
    """Counts the receives of a message; the count goes when the message is done or dead, or when
    nothing was received for ``keep_days`` (None: never)."""

    def __init__(self, most: int, keep_days: int | None):
        self.most, self.keep_millis = most, keep_days and keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.receives = handle.getValueState("receives", "n int", self.keep_millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.receives.get()
        n = held[0] if held else 0
        for row in rows:
            n += 1
            place = DONE if row["handled"] else DEAD if n >= self.most else RETRY
            yield Row(message_id=row["message_id"], body=row["body"], handled=row["handled"], attempt=n,
                      place=place)
            n = n if place == RETRY else 0
        if n:
            self.receives.update((n,))
        elif held:
            self.receives.clear()

    def close(self) -> None:
        pass


# Workers get this module with the plan, so that they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counted_receives(received: DataFrame, most: int = MAX_RECEIVES,
                     keep_days: int | None = 4) -> DataFrame:
    """Receives (message_id, body, handled) with ``attempt`` and the ``place`` the message goes to.

    Expiry goes by the clock, so a stream with ``keep_days`` runs on; one that is to end has None.
    """
    return received.groupBy("message_id").transformWithState(
        statefulProcessor=ReceiveCounter(most, keep_days), outputStructType=RECEIVED,
        outputMode="Append", timeMode="None" if keep_days is None else "ProcessingTime")


def fan_out(received: DataFrame, root: str, queue: str, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch: every receive to the journal, dead letters to a folder of their own, and
    what is to be tried again back to the queue, from where it is received once more.

    A batch that is repeated after a failure replaces its own files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        for place, path in ((DEAD, f"{root}/{DEAD}"), (RETRY, queue)):
            some = rows.filter(F.col("place") == place).select("message_id", "body", "attempt")
            results.write_partition(some, path, {"batch": str(batch_id)})
        results.write_partition(rows.drop("body"), f"{root}/journal", {"batch": str(batch_id)})
        rows.unpersist()

    return received.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drained(messages: DataFrame, handle: Callable[[DataFrame], DataFrame],
            most: int = MAX_RECEIVES, partitions: int | None = None) -> DataFrame:
    """The journal of a queue that is run until nothing is left in it: message_id, handled, attempt, place.

    ``handle`` adds ``handled`` to received rows (message_id, body, attempt; ``attempt`` counts the failed
    receives before).  A message is received ``most`` times at the most, so that is the number of runs.
    The runs have settings of their own for state, whatever the session's; ``partitions`` is the number of
    state stores, the session's if None.
    """
    spark: SparkSession = messages.sparkSession
    root = f"{shared_dir(spark)}/queue-{uuid4().hex}"
    queue, checkpoint = f"{root}/queue", f"{root}/checkpoint"
    first = messages.select(F.col("message_id").cast("string").alias("message_id"), "body",
                            F.lit(0).alias("attempt"))
    results.write_partition(first, queue, {"batch": "new"})
    schema = "message_id string, body string, attempt int, batch string"
    with state_settings(spark, partitions):
        for _ in range(most):
            stream = spark.readStream.schema(schema).parquet(queue).drop("batch")
            received = counted_receives(handle(stream), most, None)
            fan_out(received, root, queue, checkpoint).trigger(
                availableNow=True).start().awaitTermination()
    return spark.read.schema("message_id string, handled boolean, attempt int, place string").parquet(
        f"{root}/journal").drop("batch")
