"""Exact duplicates: Patricia tries own the texts.

Every task inserts its normalised texts, as whole byte strings, into compressed radix tries, one for
each (length, content hash); a terminal node stores the owner so far and how many rows ended there.
The terminals, one per distinct text of a task, are shuffled by (length, hash), so a group that holds
a third of all rows arrives as one terminal per task; there they are inserted into the final tries.
Rows then find their owner by the digest of their text.

A task's tries may hold ``spill_bytes``.  Beyond that the subtree with most bytes is spilled: its
terminals go to the shuffle, whose files Spark spills and sorts, and its memory is freed.  That only
moves work from the map side to the final tries.

Defined cases: null text counts as empty, and texts without anything but white space form one group;
a null ``doc_id`` sorts after all others; repeated rows are members like any other and each is
returned; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import SPACE, table

SPILL_BYTES = 48 << 20
NO_ID = (1 << 63) - 1

Owner = tuple[int, int, int]  # minus the code points of the original, doc_id, rows


def better(a: Owner, b: Owner) -> Owner:
    """The longer original, then the smaller id; rows add up."""
    return min(a[:2], b[:2]) + (a[2] + b[2],)


@dataclass(slots=True)
class Node:
    """``label`` leads to this node; children are keyed by the first byte of their labels."""

    label: bytes
    owner: Owner | None = None
    children: dict[int, "Node"] = field(default_factory=dict)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, found by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Patricia:
    """A compressed radix trie from byte strings to owners."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.size += len(key) - at + 200
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common_prefix(child.label, key[at:at + len(child.label)])
            upper = Node(child.label[:shared])
            child.label = child.label[shared:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += 200
            node, at = upper, at + shared
        node.owner = owner if node.owner is None else better(node.owner, owner)

    def terminals(self, start: Node | None = None, prefix: bytes = b"") -> Iterator[
            tuple[bytes, Owner]]:
        """All strings below ``start`` with their owners."""
        stack = [(start or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((child, key) for child in node.children.values())


class Forest:
    """Tries by (length, hash), spilled by subtree when they hold too much."""

    def __init__(self, spill_bytes: int):
        self.tries: dict[tuple[int, int], Patricia] = {}
        self.spill_bytes, self.held = spill_bytes, 0

    def insert(self, length: int, content_hash: int, key: bytes, owner: Owner) -> None:
        trie = self.tries.setdefault((length, content_hash), Patricia())
        before = trie.size
        trie.insert(key, owner)
        self.held += trie.size - before

    def spill(self) -> Iterator[tuple[int, int, bytes, Owner]]:
        """Terminals of the largest subtrees, until half of the limit is left."""
        if self.held <= self.spill_bytes:
            return
        for place in sorted(self.tries, key=lambda p: -self.tries[p].size):
            trie = self.tries.pop(place)
            self.held -= trie.size
            yield from ((*place, key, owner) for key, owner in trie.terminals())
            if self.held <= self.spill_bytes // 2:
                return

    def drain(self) -> Iterator[tuple[int, int, bytes, Owner]]:
        for place, trie in self.tries.items():
            yield from ((*place, key, owner) for key, owner in trie.terminals())
        self.tries, self.held = {}, 0


TERMINAL = "length long, content_hash long, content binary, points long, doc_id long, n_rows long"
_ARROW_TERMINAL = pa.schema([
    ("length", pa.int64()), ("content_hash", pa.int64()), ("content", pa.binary()),
    ("points", pa.int64()), ("doc_id", pa.int64()), ("n_rows", pa.int64())])
OWNED = "text_sha256 string, keep_id long, group_size long"
_ARROW_OWNED = pa.schema([
    ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
OUT_BYTES = 8 << 20


def _terminal_batches(found: Iterator[tuple[int, int, bytes, Owner]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for length, content_hash, key, (points, doc_id, n) in found:
        rows.append((length, content_hash, key, points, doc_id, n))
        held += len(key) + 48
        if held > OUT_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW_TERMINAL)],
                schema=_ARROW_TERMINAL)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW_TERMINAL)],
            schema=_ARROW_TERMINAL)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of terminals; few are held as Python objects at a time."""
    for begin, end in words.batches(words.sizes(batch.column(2))):
        part = batch.slice(begin, end - begin)
        yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def _combine(spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(spill_bytes)
        for batch in batches:
            for length, content_hash, key, points, doc_id, n in _rows(batch):
                forest.insert(length, content_hash, key, (points, doc_id, n))
            yield from _terminal_batches(forest.spill())
        yield from _terminal_batches(forest.drain())
    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (length, hash): one trie is held at a time."""
    place, trie, done = None, Patricia(), []

    def owned() -> Iterator[tuple[str, int | None, int]]:
        for key, (_, doc_id, n) in trie.terminals():
            yield hashlib.sha256(key).hexdigest(), None if doc_id == NO_ID else doc_id, n

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _ARROW_OWNED)],
            schema=_ARROW_OWNED)

    for batch in batches:
        for length, content_hash, key, points, doc_id, n in _rows(batch):
            if place != (length, content_hash):
                done.extend(owned())
                place, trie = (length, content_hash), Patricia()
            trie.insert(key, (points, doc_id, n))
        if len(done) > 10_000:
            yield out()
            done = []
    done.extend(owned())
    if done:
        yield out()


def owners(docs: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct normalised text: its digest, the doc_id that stays, its rows."""
    content = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "").cast("binary")
    keyed = docs.select(
        content.alias("content"), (-F.char_length(F.coalesce("text", F.lit("")))).alias("points"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
    ).select(F.octet_length("content").cast("long").alias("length"),
             F.xxhash64("content").alias("content_hash"), "content",
             F.col("points").cast("long"), "doc_id", F.lit(1).cast("long").alias("n_rows"))
    place = ["length", "content_hash"]
    return (
        keyed.mapInArrow(_combine(spill_bytes), TERMINAL)
        .repartition(*place).sortWithinPartitions(*place)
        .mapInArrow(_own, OWNED)
    )


def exact_dedup(docs: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """``docs`` with text_sha256, keep_id, group_size and kept; texts equal but for white space form
    a group, in which the longest original, then the smallest doc_id stays.

    ``kept`` marks one row of each group unless the very row that stays is repeated; of repeated
    rows ``distinct_rows`` keeps one.
    """
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "").cast("binary"), 256)
    return (
        docs.withColumn("text_sha256", digest)
        .join(owners(docs.select("doc_id", "text"), spill_bytes), "text_sha256", "left")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def distinct_rows(docs: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; a row that is repeated stays once."""
    columns = docs.columns
    return (
        exact_dedup(docs, spill_bytes).filter("kept").select(*columns)
        .dropDuplicates(["doc_id", "text"])
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group's digest, size and the document that stays."""
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {"op6_exact_dedup": r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
               FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)"""}
