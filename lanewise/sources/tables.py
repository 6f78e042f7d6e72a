"""Shipment and invoice tables, from Parquet or over JDBC.

The readers return whole tables; filters and column choices made by the operators reach the scan by
themselves, as Parquet predicates or as SQL sent to the database.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from lanewise import schemas

FETCH_SIZE = 1000


def parquet_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table with a declared schema (``lanewise.schemas``), never an inferred one."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schemas.struct(schema))
    return reader.parquet(path)


def named(df: DataFrame, key: str) -> DataFrame:
    """A table whose key is called ``id``, with the key name the operators use."""
    return df.withColumnsRenamed({"id": key, "textract_job_id": "ocr_job_id"})


def jdbc_options(url: str, table: str, first: date, last: date, partitions: int,
                 user: str, password: str, split_by: str = "created_at",
                 driver: str = "org.postgresql.Driver") -> dict[str, str]:
    """Options for a parallel JDBC read: the window ``first..last`` is cut into equal time ranges.

    The bounds only place the cuts.  Rows outside the window are still read, by the first and last
    range, unless a filter removes them.
    """
    return {
        "url": url, "dbtable": table, "user": user, "password": password, "driver": driver,
        "fetchsize": str(FETCH_SIZE), "partitionColumn": split_by,
        "lowerBound": f"{first} 00:00:00", "upperBound": f"{last + timedelta(days=1)} 00:00:00",
        "numPartitions": str(partitions), "pushDownPredicate": "true",
    }


def jdbc_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
