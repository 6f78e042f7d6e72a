"""Keyed rows in Parquet as batches that are only ever added.

    path/batch=12/  the rows of one write

The table is, per key, the last row over all batches, found by an aggregation that combines before the
shuffle.  A write costs what its batch holds; repeating it, as a stream does after a failure, replaces that
batch alone.  ``fold`` writes what is current to another path, so what is read is never removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise.operators.skew import latest
from lanewise.sources.results import write_partition

FOLDED = -1  # sorts before every number that a stream gives


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Add rows as one batch; a column named ``batch`` is not stored."""
    write_partition(rows, path, {"batch": str(batch)})


def current(spark: SparkSession, path: str, schema: StructType | str, keys: list[str],
            order: list[str]) -> DataFrame:
    """Per key the last row in ``order``, of equals that of the later batch; empty before any write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return latest(rows, keys, [*order, "batch"]).drop("batch")


def fold(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str],
         to: str, keep: str = "true") -> None:
    """Write the current rows to a new path as its first batch, and go on there.

    Rows for which the condition ``keep`` is false stay behind; null counts as true.
    """
    rows = current(spark, path, schema, keys, order)
    append(rows.filter(F.coalesce(F.expr(keep), F.lit(True))), to, FOLDED)
