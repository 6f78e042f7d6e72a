"""Message streams in and out, and the split into good and unreadable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lanewise import schemas
from lanewise.functions import messages


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """One message per line from files landing in a folder, as column ``body``."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
            .withColumnRenamed("value", "body"))


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 rows_per_trigger: int = 1_000_000) -> DataFrame:
    """Messages of a topic as ``body`` and arrival time ``received_at``; needs the Kafka package."""
    rows = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("maxOffsetsPerTrigger", rows_per_trigger).load())
    return rows.select(F.col("value").cast("string").alias("body"),
                       F.col("timestamp").alias("received_at"))


def parse(queue: DataFrame, schema: str, into: str = "event") -> DataFrame:
    """Unwrap envelopes and read the message; ``readable`` tells whether that worked."""
    full = f"{schema}, {schemas.CORRUPT} string"
    return (
        queue.withColumn("message", messages.unwrap(F.col("body")))
        .withColumn(into, F.from_json("message", full, schemas.PARSE_OPTIONS))
        .withColumn("readable", F.col("message").isNotNull() & F.col(into).isNotNull()
                    & F.col(f"{into}.{schemas.CORRUPT}").isNull())
    )


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter("readable").drop("readable", "message", "body")


def unreadable(parsed: DataFrame) -> DataFrame:
    """What belongs in quarantine: the raw bodies."""
    return parsed.filter("NOT readable").select("body")


def to_messages(events: DataFrame, payload: list[str], event_type: Column,
                correlation_id: Column) -> DataFrame:
    """Events as messages: JSON body, routing attributes and subject."""
    kind = event_type.alias("eventType")
    correlation = messages.correlation_or_unknown(correlation_id)
    return events.select(
        messages.to_body(kind, *payload).alias("value"),
        event_type.alias("event_type"), correlation.alias("correlation_id"),
        event_type.alias("subject"))


def append_stream(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A checkpointed append to Parquet: every row lands exactly once."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))
