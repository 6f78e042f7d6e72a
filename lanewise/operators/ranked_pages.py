"""Pages by number, however deep: a stored order with its cumulative counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.fixed_values import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE
from lanewise.operators.search import newest_first

PART = "page_part"


def store_order(df: DataFrame, key: str, path: str, parts: int | None = None) -> None:
    """Write rows newest first, cut into ``parts`` ranges of that order (a folder each).

    Ranges come from Spark's sample, so they hold about equally many rows; ``key`` breaks ties, also
    between ranges.
    """
    order = [F.col("created_at").desc(), F.col(key)]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    (ranged.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy(PART).parquet(path))


def part_counts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(range, rows), in order, from the files' footers: as many as there are ranges."""
    counted = spark.read.parquet(path).groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r[PART], r["n"]) for r in counted.collect())


def ranges_of(counts: list[tuple[int, int]], number: int, size: int) -> tuple[list[int], int]:
    """The ranges that hold a page, and the rows of the first one that come before it."""
    begin, before, skipped, chosen = number * size, 0, 0, []
    for part, n in counts:
        if before + n > begin and before < begin + size:
            skipped = skipped if chosen else begin - before
            chosen.append(part)
        before += n
    return chosen, skipped


def stored_page(spark: SparkSession, path: str, key: str, number: int = 0,
                size: int = DEFAULT_PAGE_SIZE,
                counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """``search.page`` of a stored order: only the ranges that hold the page are read.

    ``counts`` of an earlier page saves counting again.
    """
    size = min(size, MAX_PAGE_SIZE)
    chosen, skipped = ranges_of(counts or part_counts(spark, path), number, size)
    rows = spark.read.parquet(path).filter(F.col(PART).isin(chosen)).drop(PART)
    return newest_first(rows, key).offset(skipped).limit(size)
