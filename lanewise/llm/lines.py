"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines are hashed (128 bit), and so is every row.  Windows that occur more than once anywhere keep
their first occurrence, by (doc_id, hash of the text, line); the lines covered by any later occurrence
go, overlapping windows merged.  Windows are judged on the input.

Windows are counted with map-side aggregation; a repeated window's first place is unique, so that the
join back to all its places can be split by adaptive execution where a window is hot.  Texts are
shuffled once, to meet their own covered lines.

Defined cases: null text counts as empty; texts with fewer than three lines have no window and keep
all; blank lines are lines; rows equal in id and text are one document, so neither loses lines to the
other; a null doc_id comes before all others; an empty table gives an empty result; other columns are
not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import table

SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, kept_text."""
    keyed = docs.select(F.struct(F.xxhash64("doc_id", "text").alias("low"),
                                 F.xxhash64(F.lit(SIZE), "text", "doc_id").alias("high")).alias("row_key"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = F.size("lines")

    def window(i: Column) -> Column:
        own = [F.get("lines", i + k) for k in range(SIZE)]
        return F.struct(i.alias("line"), F.xxhash64(*own).alias("low_hash"),
                        F.xxhash64(F.lit(SIZE), *own).alias("high_hash"))

    windows = (
        keyed.select("row_key", "doc_id", _lines(F.col("text")).alias("lines"))
        .filter(count >= SIZE)
        .select("row_key", "doc_id", F.explode(F.transform(
            F.sequence(F.lit(0), count - SIZE), window)).alias("w"))
        .select("w.low_hash", "w.high_hash",
                F.struct("doc_id", "row_key", "w.line").alias("place"))
    )
    hashes = ["low_hash", "high_hash"]
    first = windows.groupBy(*hashes).agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = (
        windows.join(first, hashes).filter("place > first")
        .groupBy("place.row_key").agg(F.collect_set("place.line").alias("starts"))
    )
    covered = F.array_distinct(F.flatten(F.transform(
        "starts", lambda i: F.sequence(i, i + SIZE - 1))))
    places = F.sequence(F.lit(0), count - 1)
    return (
        keyed.join(later, "row_key", "left")
        .select("doc_id", _lines(F.col("text")).alias("lines"),
                F.coalesce(covered, F.array().cast("array<int>")).alias("covered"))
        .select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                F.size("covered").cast("long").alias("n_removed"),
                F.array_join(F.transform(F.array_except(places, F.col("covered")),
                                         lambda i: F.get("lines", i)), "\n").alias("kept_text"))
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of later occurrences of three-line windows."""
    return without_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {"op4_line_dedup": """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
    w AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o
                 AS three FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    later AS (
        SELECT doc_id, i FROM (
            SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS n
            FROM w WHERE three IS NOT NULL) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM later)
    SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), ''))
               AS kept_sha256
    FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id"""}
