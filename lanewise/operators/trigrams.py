"""Substring search by trigram postings: candidates from the postings, then the exact test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.search import contains_text

GROUPS = 64
GROUP = "value_group"


def _grams(value: Column) -> Column:
    """The different runs of three characters of a text."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(value) - 2, F.lit(0))),
        lambda i: F.substring(value, i, F.lit(3))))


def _group(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(GROUPS)).cast("int")


def store(df: DataFrame, column: str, path: str) -> None:
    """Write rows in groups of the lower-cased column's hash, and the groups' postings.

    A posting is a trigram and a group that holds it: at most ``GROUPS`` rows per trigram, however often it
    occurs, so postings stay small where texts are many; they combine before the shuffle.
    """
    value = F.lower(F.col(column))
    rows = df.withColumn(GROUP, _group(F.coalesce(value, F.lit(""))))
    (rows.hint("rebalance", GROUP).write.mode("overwrite").partitionBy(GROUP)
     .parquet(f"{path}/rows"))
    postings = (
        rows.filter(F.char_length(value) >= 3)
        .select(F.explode(_grams(value)).alias("gram"), GROUP).distinct()
    )
    (postings.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite")
     .parquet(f"{path}/postings"))


def literal_grams(query: str) -> list[str]:
    """Trigrams that every match holds: those of the stretches between wildcards."""
    found: list[str] = []
    for stretch in query.lower().replace("_", "%").split("%"):
        found += [stretch[i:i + 3] for i in range(len(stretch) - 2)]
    return sorted(set(found))


def candidate_groups(spark: SparkSession, path: str, query: str) -> list[int] | None:
    """Groups that hold every trigram of the query, at most ``GROUPS``; None if it has none."""
    grams = literal_grams(query)
    if not grams:
        return None
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(grams))
    held = postings.groupBy(GROUP).agg(F.count_distinct("gram").alias("n"))
    return sorted(r[GROUP] for r in held.filter(F.col("n") == len(grams)).select(GROUP).collect())


def search(spark: SparkSession, path: str, **contains: str) -> DataFrame:
    """Rows whose stored column contains the query, with its wildcards; only groups whose postings allow a
    match are read.  A query without three literal characters in a row reads all."""
    rows = spark.read.parquet(f"{path}/rows")
    for query in contains.values():
        groups = candidate_groups(spark, path, query)
        if groups is not None:
            rows = rows.filter(F.col(GROUP).isin(groups))
    exact = reduce(Column.__and__, (contains_text(F.col(c), q) for c, q in contains.items()))
    return rows.filter(exact).drop(GROUP)
