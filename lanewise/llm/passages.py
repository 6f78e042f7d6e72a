"""Substring dedup: seed and extend.

A window is ``LENGTH`` consecutive words.  Winnowing gives every window an anchor: of the ``SEED``-word
runs inside it, the one with the smallest hash (the rightmost of equals).  Equal windows have equal
anchors at equal places, so a repeated window lies around two places that share an anchor; an anchor
that occurs once needs no further look.

*Seed.*  Places whose anchor occurs more than once are joined on it: about one word in sixteen is such
a place.

*Extend.*  A place stands for the windows that chose it, a span of up to 2 * LENGTH words.  Places whose
whole spans are equal extend each other in full, both ways, and are one *context* from here on, so
copies are never paired.  Contexts of the same anchor that differ extend only in part: each distinct
context gives its windows, counted once over all contexts.  A window is repeated if its context has
several places, or several contexts hold it.  Repeated windows that overlap or touch join to maximal
repeats, the removed spans.

Hashes decide: 128 bits for rows, contexts and windows; 64 for anchors, where a false equality only adds
a place to look at.  No step gathers the places of an anchor, a context or a window: they are counted with
map-side aggregation, and the joins' other sides are unique and their results dealt anew, so that adaptive
execution may split a hot one.  Texts are shuffled once.

Defined cases: null, empty and wordless texts, and texts shorter than a window, keep all their words;
repeated rows are places like any other, so each loses what the other holds; a null doc_id is carried;
an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import table

LENGTH, SEED = 35, 6
_OTHER = np.uint64(0x5851F42D4C957F2D)

# A place in one number: the anchor's word, then how far before it the first window starts, and how
# many windows follow the first.
_BITS = 8


def _places(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor's word, first and last window that chose it, anchor) of several texts' words."""
    span, n = length - SEED + 1, len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    seeds = best = words.windows(hashes, SEED)
    at, width = np.arange(len(best)), 1
    while width < span:  # the smallest of ``width`` seeds, doubling; the right one of equals
        step = min(width, span - width)
        right = best[step:] <= best[:-step]
        best = np.where(right, best[step:], best[:-step])
        at = np.where(right, at[step:], at[:-step])
        width += step
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.flatnonzero(np.arange(n) + length <= first[1:][owner])
    at, owner = at[inside], owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(inside))[:len(begin)] - 1
    return owner[begin], at[begin], inside[begin], inside[end], seeds[at[begin]]


class _Runs:
    """Hashes of any runs of words, from two independent sums."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = words._word_powers.get(len(hashes) + 1)
        self.sums = []
        for h in (hashes, words.mix(hashes ^ _OTHER)):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.up[:-1], out=total[1:])
            self.sums.append(total)

    def get(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total = self.sums[which]
        return words.mix((total[end] - total[begin]) * self.down[begin])


_PLACES = pa.schema([(c, pa.int64()) for c in
                     ("key_a", "key_b", "place", "anchor", "context_a", "context_b")])


def _place_finder(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_a, key_b = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in words.batches(texts):
                split = words.split(texts[begin:end])
                owner, at, low, high, anchor = _places(split.hashes, split.first, length)
                shape = (at - low) << _BITS | (high - low)
                runs, mixed = _Runs(split.hashes), words.mix(shape.astype(np.uint64))
                place = (at - split.first[owner]) << 2 * _BITS | shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key_a[begin:end][owner]), pa.array(key_b[begin:end][owner]),
                     pa.array(place), pa.array(anchor.view(np.int64)),
                     *(pa.array((runs.get(low, high + length, i) ^ mixed).view(np.int64))
                       for i in (0, 1))], schema=_PLACES)
    return run


_WINDOWS = pa.schema([("low_hash", pa.int64()), ("high_hash", pa.int64()),
                      ("key_a", pa.int64()), ("key_b", pa.int64()), ("first", pa.int64()),
                      ("alone", pa.bool_())])


def _window_finder(length: int):
    """Windows of the marked places of a row: marks are places, doubled, plus 1 if alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = [batch.column(i).to_numpy() for i in (0, 1)], batch.column(3)
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in words.batches(texts):
                split = words.split(texts[begin:end])
                own = marks.slice(begin, end - begin)
                n = np.diff(own.offsets.to_numpy())
                owner = np.repeat(np.arange(end - begin), n)
                mark = own.flatten().to_numpy()
                alone, place = (mark & 1).astype(bool), mark >> 1
                at = split.first[owner] + (place >> 2 * _BITS)
                low = at - (place >> _BITS & (1 << _BITS) - 1)
                count = (place & (1 << _BITS) - 1) + 1
                first = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                owner, alone = np.repeat(owner, count), np.repeat(alone, count)
                runs = _Runs(split.hashes)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(runs.get(first, first + length, i).view(np.int64))
                       for i in (0, 1)),
                     *(pa.array(k[begin:end][owner]) for k in keys),
                     pa.array(first - split.first[owner]), pa.array(alone)], schema=_WINDOWS)
    return run


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans; a span is first << 32 | words."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        spans = batch.column(2)
        for begin, end in words.batches(texts):
            counts, kept, removed = [], [], []
            for text, marks in zip(texts[begin:end], spans.slice(begin, end - begin).to_pylist(),
                                   strict=True):
                found = (text or b"").split()
                counts.append(len(found))
                merged: list[list[int]] = []
                for mark in sorted(marks or ()):
                    first, last = mark >> 32, (mark >> 32) + (mark & 0xFFFFFFFF)
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                if merged:
                    stays = np.ones(len(found), bool)
                    for first, last in merged:
                        stays[first:last] = False
                    found = compress(found, stays.tolist())
                kept.append(b" ".join(found).decode("utf-8"))
                removed.append([{"first": a, "last": b - 1} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(begin, end - begin), pa.array(counts, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(removed, _SPANS)],
                names=["doc_id", "n_words", "kept_text", "removed"])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, kept_text, and ``removed``, the
    maximal repeats as first and last word; ``length`` is at least SEED and at most 200."""
    key, context = ["key_a", "key_b"], ["context_a", "context_b"]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key_a"),
                        F.xxhash64(F.lit(1), "text", "doc_id").alias("key_b"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = keyed.select(*key, "text").mapInArrow(
        _place_finder(length), ", ".join(f"{f.name} long" for f in _PLACES)
    ).filter(" and ".join(f"{f.name} is not null" for f in _PLACES))  # always true
    repeated = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeded = places.join(repeated.select("anchor"), "anchor")
    contexts = seeded.groupBy(*context).agg(
        F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"),
        F.min(F.struct(*key, "place")).alias("one"),
    ).filter("n > 0 and one is not null and anchor is not null"  # always true, so that one
             " and context_a is not null and context_b is not null")  # exchange serves all uses
    mixed = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")

    def span(first, n_words):
        return F.shiftleft(first, 32).bitwiseOR(n_words)

    mask = (1 << _BITS) - 1
    at = F.shiftright("place", 2 * _BITS)
    before, more = F.shiftright("place", _BITS).bitwiseAND(mask), F.col("place").bitwiseAND(mask)
    whole = seeded.join(contexts.filter("n > 1").select(*context), context).select(
        *key, span(at - before, more + length).alias("span"))

    marks = (
        contexts.join(mixed.select("anchor"), "anchor")
        .select("one.key_a", "one.key_b",
                (F.col("one.place") * 2 + (F.col("n") == 1).cast("long")).alias("mark"))
        .groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    )
    windows = (
        keyed.join(marks, key).dropDuplicates(key)
        .select(*key, "text", "marks", "doc_id").mapInArrow(  # doc_id: one exchange serves both
            _window_finder(length),
            "low_hash long, high_hash long, key_a long, key_b long, first long, alone boolean")
    )
    hashes = ["low_hash", "high_hash"]
    again = windows.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    part = windows.filter("alone").join(again.select(*hashes), hashes).select(
        *key, span(F.col("first"), F.lit(length).cast("long")).alias("span"))

    spans = whole.union(part).groupBy(*key).agg(F.collect_set("span").alias("spans"))
    return keyed.join(spans, key, "left").select("doc_id", "text", "spans").mapInArrow(
        _remover, "doc_id long, n_words long, kept_text string, "
                  "removed array<struct<first:bigint,last:bigint>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    found = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"),
                       lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", "n_words", gone.alias("n_removed"),
                        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# Whole tables are beyond list functions of SQL; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
