"""What the operators share: reading a table, folds, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import reliable  # noqa: F401

# White space of all contracts: blank and the five ASCII controls; other white space is text.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table; columns with other names cannot clash with ours."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(folds))
