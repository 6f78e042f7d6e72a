"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import reliable


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one partition's edges, as stars around their smallest nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = (find(parent.setdefault(x, x)) for x in (u, v))
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in parent]
    stars = [(x, root) for x, root in stars if x != root]
    yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in stars], pa.int64()),
                                      "v": pa.array([r for _, r in stars], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Each partition contracts its own edges.  Then two star operations alternate: every node ties its
    larger neighbours to its smallest one, then every node ties its smaller neighbours (and itself)
    to the smallest.  All keep components and shrink their depth, until every edge points at its
    root.  A hub's neighbours are only ever aggregated to a minimum and joined back, so no group is
    gathered in one task; each round is written to the shared folder, and has no more edges than
    the one before.
    """
    now = reliable(edges.select("u", "v").mapInArrow(_contracted, "u long, v long"))
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        now = reliable(small.mapInArrow(_contracted, "u long, v long"))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
