"""Ordered work per key, for keys of any size: lazy, native, the same at every size.

A key's rows are cut into slices by a coarse value of the first sort column (an hour, a thousand, the
first letters), so the cuts need no sampling and follow the order.  Windows run inside slices; what
passes from slice to slice is one small row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

NUMBERS_PER_SLICE = 1024
LETTERS_PER_SLICE = 3


def coarse(df: DataFrame, column: str, unit: str = "hour") -> Column:
    """A value that grows with the column and is shared by a stretch of it."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, TimestampType):
        return F.date_trunc(unit, value)
    if isinstance(kind, NumericType):
        return F.floor(value / NUMBERS_PER_SLICE)
    if isinstance(kind, StringType):
        return F.substring(value, 1, LETTERS_PER_SLICE)
    if isinstance(kind, DateType):
        return value
    return F.lit(0)


def on_slices(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys and slice; a slice may be null."""
    names = [*keys, "slice"]
    other = right.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c)
                           for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return left.join(other, same, "left").drop(*[f"_{c}" for c in names])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their ``ordinal`` per key, from 1, in the given order."""
    cut = df.withColumn("slice", coarse(df, order[0]))
    inside = Window.partitionBy(*keys, "slice").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_earlier"))
    return (
        on_slices(cut.withColumn("n_here", F.row_number().over(inside)), sizes, keys)
        .withColumn("ordinal", F.col("n_earlier") + F.col("n_here"))
        .drop("slice", "n_here", "n_earlier")
    )


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, alias: str,
                   unit: str = "day") -> DataFrame:
    """The value of the row before, per key; ``order`` must be unique within a key.

    A window looks back inside each slice, and the first row of a slice takes the last value of the
    slice before.
    """
    cut = df.withColumn("slice", coarse(df, order[0], unit))
    inside = Window.partitionBy(*keys, "slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("slice")
    ends = (
        cut.groupBy(*keys, "slice")
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("last_row"))
        .select(*keys, "slice", F.lag(f"last_row.{value}").over(across).alias("carried"))
    )
    looked = cut.withColumn("n_here", F.row_number().over(inside)).withColumn(
        "inside", F.lag(value).over(inside))
    return (
        on_slices(looked, ends, keys)
        .withColumn(alias, F.when(F.col("n_here") == 1, F.col("carried"))
                    .otherwise(F.col("inside")))
        .drop("slice", "n_here", "inside", "carried")
    )


def pages(df: DataFrame, key: str, fields: list[str], alias: str, page_rows: int) -> DataFrame:
    """Rows per key as sorted arrays of structs, in pages of ``page_rows`` rows, from page 0.

    Pages are contiguous: page 1 goes on where page 0 ends.
    """
    rows = numbered(df.filter(F.col(key).isNotNull()), [key], fields)
    item = F.struct("ordinal", F.struct(*fields).alias("item"))
    return (
        rows.withColumn("part", F.floor((F.col("ordinal") - 1) / page_rows).cast("int"))
        .groupBy(key, "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(key, "part", F.col("items.item").alias(alias))
    )


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row per key in the given order, by aggregation: combines before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("newest")
    picked = df.groupBy(*keys).agg(newest).select(*keys, "newest.*")
    return picked.select(*df.columns)


def earliest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    oldest = F.min_by(F.struct(*others), F.struct(*order)).alias("oldest")
    picked = df.groupBy(*keys).agg(oldest).select(*keys, "oldest.*")
    return picked.select(*df.columns)
