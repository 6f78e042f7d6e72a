"""Stored objects: notifications, key parsing, indexing and OCR hand-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schemas
from lanewise.fixed_values import OCR_EVENT
from lanewise.functions import messages, text
from lanewise.operators.upsert import put_rows, update_columns

INDEXED_COLUMNS = ["shipment_id", "document_type", "s3_key", "s3_bucket", "file_name",
                   "content_type", "file_size_bytes", "status", "indexed_at"]


def objects(notifications: DataFrame, body: str = "body") -> DataFrame:
    """One row per object of a notification: bucket, decoded key and size (0 if not told).

    Decoding also turns ``+`` into a space; a percent sign that starts no escape stays.  Columns of
    the notification are kept.
    """
    raw = F.col("record.s3.object.key")
    decoded = F.url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))
    parsed = F.from_json(F.col(body), schemas.OBJECT_NOTIFICATION)
    kept = [c for c in notifications.columns if c != body]
    return (
        notifications.select(*kept, F.explode(parsed["Records"]).alias("record"))
        .select(*kept, F.col("record.s3.bucket.name").alias("s3_bucket"),
                decoded.alias("s3_key"),
                F.coalesce("record.s3.object.size", F.lit(0)).alias("file_size_bytes"))
    )


def _part(key: Column, number: int) -> Column:
    return F.get(F.split(key, "/"), F.lit(number))


def parse_keys(stored: DataFrame) -> DataFrame:
    """Document fields from ``type/shipment/document.ext``.

    ``outcome`` is SKIPPED for keys with fewer than three parts, FAILED for objects without a key.
    """
    key = F.col("s3_key")
    file_name = _part(key, 2)
    stem, extension = text.split_file_name(F.col("file_name"))
    enough = F.size(F.split(key, "/")) >= 3
    return (
        stored.withColumn("outcome", F.when(key.isNull(), "FAILED").when(enough, "INDEXED")
                          .otherwise("SKIPPED"))
        .withColumn("file_name", F.when(enough, file_name))
        .withColumns({
            "document_type": F.when(enough, F.upper(_part(key, 0))),
            "shipment_id": F.when(enough, _part(key, 1)),
            "document_id": stem,
            "extension": extension,
        })
        .withColumn("content_type", F.when(enough, text.content_type(F.col("extension"))))
    )


def index_updates(parsed: DataFrame, indexed_at: Column) -> DataFrame:
    """What the indexer writes for each parsed document."""
    return (
        parsed.filter(F.col("outcome") == "INDEXED")
        .withColumn("status", F.lit("INDEXED"))
        .withColumn("indexed_at", indexed_at)
        .select("document_id", *INDEXED_COLUMNS)
    )


def index_documents(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """The document table after indexing; uploader and description survive."""
    return update_columns(existing, updates, "document_id", INDEXED_COLUMNS,
                          ["indexed_at", "s3_key"])


def register(existing: DataFrame, requests: DataFrame, uploaded_at: Column) -> DataFrame:
    """The document table after registering uploads; a re-registered document is replaced."""
    stamped = requests.withColumn("status", F.lit("UPLOADED")).withColumn(
        "uploaded_at", uploaded_at)
    return put_rows(existing, stamped, "document_id", ["uploaded_at", "s3_key"])


def batch_counts(parsed: DataFrame) -> DataFrame:
    """Processed (skipped keys count as processed) and failed objects."""
    failed = F.col("outcome") == "FAILED"
    return parsed.agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"))


def ocr_candidates(stored: DataFrame) -> DataFrame:
    """Objects with ``ocr_outcome`` STARTED or SKIPPED and the ids read from the key."""
    key = F.col("s3_key")
    parts = F.size(F.split(key, "/"))
    name = F.when(parts >= 3, _part(key, 2)).otherwise(key)
    stem, _ = text.split_file_name(F.col("ocr_name"))
    return (
        stored.withColumn("ocr_outcome", F.when(text.is_invoice_document(key), "STARTED")
                          .otherwise("SKIPPED"))
        .withColumn("ocr_name", name)
        .withColumn("shipment_id", F.when(parts >= 2, _part(key, 1)).otherwise("unknown"))
        .withColumn("document_id", stem)
        .drop("ocr_name")
    )


def ocr_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("ocr_outcome").agg(F.count(F.lit(1)).alias("objects"))


def ocr_messages(candidates: DataFrame, job_id: Column, started_at: Column) -> DataFrame:
    """Job-started messages for the invoices among the objects; the job id comes from outside."""
    kind = F.lit(OCR_EVENT)
    body = messages.to_body(
        kind.alias("eventType"), F.col("job_id").alias("textractJobId"),
        F.col("document_id").alias("documentId"), F.col("shipment_id").alias("shipmentId"),
        F.col("s3_key").alias("s3Key"), F.col("s3_bucket").alias("s3Bucket"),
        F.col("started_at").alias("startedAt"))
    return (
        candidates.filter(F.col("ocr_outcome") == "STARTED")
        .withColumn("job_id", job_id).withColumn("started_at", started_at)
        .select(kind.alias("event_type"), "job_id", "document_id", "shipment_id", "s3_key",
                "s3_bucket", "started_at", body.alias("body"))
    )


def jobs_with_documents(jobs: DataFrame, documents: DataFrame,
                        shipments: DataFrame) -> DataFrame:
    """OCR jobs with their document and, if known, their shipment."""
    about = documents.select("document_id", "file_name", "content_type", "uploaded_by")
    owner = shipments.select("shipment_id", "reference_no", "carrier_id")
    return (
        jobs.select("job_id", "document_id", "shipment_id")
        .join(about, "document_id", "left").join(owner, "shipment_id", "left")
    )
