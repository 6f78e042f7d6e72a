"""Benchmark decontamination: MinHash containment search, partitioned by size.

A benchmark item is a few dozen shingles, a document may hold a million, so the Jaccard similarity of
the two says nothing.  Containment needs only the item's side: an item's MinHash sample (its shingles
with the smallest hashes) is a uniform sample of its set, and the share of the sample that a document
holds estimates the share of the item.  Items are partitioned by size (powers of two); a partition
fixes how many samples its items have and how many of them a document must hold to become a candidate
(five standard deviations below the threshold, and exactly the threshold where the sample is the
whole set).  Candidates are verified on the item's full shingle set.

Items go round in blocks of ``BLOCK_SHINGLES`` shingles, each block broadcast within that bound and
met by all documents in one pass without a shuffle; the number of passes grows with the benchmark.

Words are lower-cased (A-Z) runs of letters, digits and everything outside ASCII, so punctuation and
line breaks do not hide a leak.  Defined cases: null, empty and wordless texts, of either table, match
nothing; texts with fewer words than a shingle are one shingle; each row is judged by itself, so
repeated rows of either table give repeated pairs; null ids are carried; empty tables give an empty
result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import reliable, table

SIZE, PERCENT = 5, 80
SAMPLES = 64
BLOCK_SHINGLES = 1 << 20
PAIRS = "doc_id long, item_id long, n_item long, n_common long"
_ARROW_PAIRS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item", "n_common")])


def sample_size(partition: int) -> int:
    """Samples of items with 2**partition shingles or more; small items are their own sample."""
    return min(2 << partition, SAMPLES)


def candidate_hits(samples: int, shingles: int, percent: int) -> int:
    """Samples that a document must hold: five standard deviations below the threshold.

    Samples are drawn without replacement, so the deviation is 0 where all shingles are drawn.
    """
    share = percent / 100
    if samples >= shingles:
        return -(-percent * shingles // 100)
    spread = math.sqrt(share * (1 - share) / samples * (shingles - samples) / (shingles - 1))
    return max(1, math.floor(samples * (share - 5 * spread)))


class Items:
    """A block of items: full shingle sets, and samples indexed by hash."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        hashes, owners, self.hits = [], [], np.zeros(len(ids), np.int64)
        for i, shingles in enumerate(sets):
            drawn = sample_size(len(shingles).bit_length() - 1)
            rank = np.sort(words.mix(shingles))[:drawn]
            hashes.append(rank)
            owners.append(np.full(len(rank), i))
            self.hits[i] = candidate_hits(len(rank), len(shingles), percent)
        found, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(found, kind="stable")
        self.hashes, self.first = np.unique(found[order], return_index=True)
        self.owners = owner[order]
        self.first = np.append(self.first, len(owner))
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def samples_in(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``shingles`` that are samples, and which."""
        ranks = words.mix(shingles)
        place = np.flatnonzero(self.may[(ranks >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, ranks[place]), len(self.hashes) - 1)
        same = self.hashes[at] == ranks[place]
        return place[same], at[same]


def _shingles(split: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles and the texts they belong to; short texts have their whole sequence."""
    counts = np.diff(split.first)
    runs = words.windows(split.hashes, size)
    owner = split.text_of[:len(runs)]
    whole = np.arange(len(runs)) + size <= split.first[1:][owner]
    values, owners = [runs[whole]], [owner[whole]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        values.append(words.windows(split.hashes, n)[split.first[short]])
        owners.append(short)
    return np.concatenate(values), np.concatenate(owners)


def find(texts: pa.Array, items: Items, size: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, shingles in common) for all that reach the threshold."""
    for begin, _, part in words.parts(texts):
        split = words.split(part, words.NOT_ALPHANUMERIC, lower=True)
        values, owner = _shingles(split, size)
        place, sample = items.samples_in(values)
        hit = np.unique(np.stack([owner[place], sample]), axis=1)
        n = items.first[hit[1] + 1] - items.first[hit[1]]
        text = np.repeat(hit[0], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = items.owners[np.repeat(items.first[hit[1]], n) + within]
        pairs, hits = np.unique(np.stack([text, item]), axis=1, return_counts=True)
        enough = hits >= items.hits[pairs[1]]
        ours, at = None, -1
        for t, i in pairs[:, enough].T.tolist():
            if t != at:
                ours, at = np.unique(values[owner == t]), t
            common = len(np.intersect1d(ours, items.sets[i], assume_unique=True))
            if 100 * common >= items.percent * len(items.sets[i]):
                yield begin + t, i, common


def _finder(block, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*block.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(ids[t], items.ids[i], len(items.sets[i]), common)
                     for t, i, common in find(batch.column(1), items, size)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                    schema=_ARROW_PAIRS)
    return run


def _item_sets(size: int):
    schema = pa.schema([("item_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, end, texts in words.parts(batch.column(1)):
                split = words.split(texts, words.NOT_ALPHANUMERIC, lower=True)
                values, first = words.shingle_sets(split, size)
                sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin).cast(pa.int64()), pa.array(sets, pa.binary())],
                    schema=schema)
    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                    percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item, n_common) where a row of ``docs`` (doc_id, text) holds at least
    ``percent`` of the shingles of a row of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    sets = reliable(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInArrow(_item_sets(size), "item_id long, shingles binary")
        .filter(F.octet_length("shingles") > 0))
    total = sets.agg(F.sum(F.octet_length("shingles") / 8)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_shingles))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], PAIRS)
    for number in range(blocks):
        block = sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == number)
        rows = block.collect()  # within the bound of a block
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((
            [r.item_id for r in rows],
            [np.frombuffer(bytes(r.shingles), np.uint64) for r in rows], percent))
        met = given.mapInArrow(_finder(sent, size), PAIRS)
        found = found.union(reliable(met) if blocks > 1 else met)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
                   percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item.

    Rows are judged by themselves: they are told apart by a hash of id and text, so one without an id, or
    with an id that others have too, goes for what it holds itself.
    """
    row = F.xxhash64("doc_id", "text")
    leaks = contained_items(docs.select(row.alias("doc_id"), "text"), benchmark, size, percent).select(
        F.col("doc_id").alias("leaking_row")).distinct()
    return docs.join(leaks, F.xxhash64(docs["doc_id"], docs["text"]) == leaks["leaking_row"],
                     "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the containment of each."""
    found = contained_items(table(spark, sf_dir, "documents", "doc_id", "text"),
                            table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


ORACLE = {"op5_decontamination": r"""
    WITH given AS (
        SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL
        SELECT 1, item_id, text FROM benchmark),
    split AS (
        SELECT side, id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM given),
    shingled AS (
        SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
                   lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM split WHERE len(w) > 0),
    sizes AS (SELECT id, count(*) AS n FROM shingled WHERE side = 1 GROUP BY id),
    common AS (
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common
        FROM shingled d JOIN shingled i ON d.s = i.s AND d.side = 0 AND i.side = 1
        GROUP BY d.id, i.id)
    SELECT doc_id, item_id, n AS n_item, n_common, n_common / n AS containment
    FROM common JOIN sizes ON id = item_id WHERE 100 * n_common >= 80 * n"""}
