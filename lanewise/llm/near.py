"""Near duplicates by odd sketches.

1. A document's set of word shingles is hashed (64 bit).  Documents with equal sets form a class; only
   a class is compared from here on, so copies are never expanded.
2. ``SAMPLES`` MinHash samples per class: the first fill ``BANDS`` bands of ``ROWS``; all are folded
   into a parity bitmap, the odd sketch: sample i with value v flips one bit chosen by (i, v).
   The number of odd bits in the XOR of two sketches estimates their difference, and is precise for
   high similarities: J = 1 + n / (4 k) * ln(1 - 2 odd / n) for n bits and k samples.
3. Classes that share a band are candidates.  First each one meets its bucket's hub.  Candidates
   whose sketches agree are confirmed on their full shingle sets; links are joined to components.
4. Buckets that still hold several components are compared in blocks: pairs of different components
   whose sketches agree are confirmed on their full sets right there, the likeliest first, until
   the block knows how its components hang together.  A block emits a forest, never all pairs, and
   pairs within a component need no check, so tight groups cost little and no pair is left out.

A pair at a similarity of 0.8 shares no band with probability (1 - 0.8**6)**42 < 3e-6 (a pair at 0.85
with 1e-9), and fails the sketch's cut-off, worked out exactly, with a probability of 7.7e-9.

Blocks hold about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles, so a bucket of any size is spread
over many tasks.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and keep their own
id as component; fewer words than a shingle form one shingle; repeated rows and equal sets share a
class; a null ``doc_id`` takes part, is never smallest, and is kept only where its whole component has
no id; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import reliable, table
from lanewise.llm.graph import components

SAMPLES, BANDS, ROWS = 256, 42, 6
BITS = 512
SKETCH_LOSS = 1e-8  # probability that sketches drop a pair at the threshold
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SIGNED = ("row_key struct<doc_id:bigint,text_hash:bigint>, n_shingles long, node long, "
          "bands array<bigint>, sketch array<bigint>")

_SEEDS = words.mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_XOR = (_SEEDS[:SAMPLES] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SEEDS[SAMPLES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SAMPLE_NUMBERS = (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x BITS / 64) of the samples (SAMPLES x rows)."""
    n = samples.shape[1]
    bit = words.mix(samples.astype(np.uint64) | _SAMPLE_NUMBERS[:, None]) % np.uint64(BITS)
    place = np.arange(n, dtype=np.uint64)[None, :] * np.uint64(BITS) + bit
    odd = (np.bincount(place.ravel().astype(np.int64), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.uint64)


def similarity(odd_bits: np.ndarray | int) -> np.ndarray:
    """Jaccard similarity estimated from the number of odd bits of the XOR."""
    free = np.maximum(1 - 2 * np.asarray(odd_bits) / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(free)


def odd_bits_beyond(similarity: float) -> np.ndarray:
    """At k, the probability that the sketches of a pair of that similarity differ in more than k bits.

    Each sample differs with a probability of 1 - similarity and then flips two bits drawn alike.
    """
    differ = 1 - similarity
    bits = np.arange(BITS + 1)
    now, odd = (bits == 0).astype(float), np.zeros(BITS + 1)
    for n in range(SAMPLES + 1):
        odd += math.comb(SAMPLES, n) * differ**n * similarity**(SAMPLES - n) * now
        for _ in range(2):
            up, down = now * (BITS - bits) / BITS, now * bits / BITS
            now = np.append(0, up[:-1]) + np.append(down[1:], 0)
    return np.append(np.cumsum(odd[::-1])[::-1][1:], 0)


def most_odd_bits(percent: int) -> int:
    """The cut-off: the least that drops a pair at the threshold with at most ``SKETCH_LOSS``."""
    return int(np.argmax(odd_bits_beyond(percent / 100) <= SKETCH_LOSS))


def sign(texts: list[bytes | None], size: int) -> tuple[np.ndarray, ...]:
    """The number of shingles of each text; class, bands and sketch of each that has shingles."""
    values, first = words.shingle_sets(words.split(texts, lower=True), size)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        none = np.zeros((0, 1), np.uint64)
        return counts, none[:, 0], none, none
    at = first[:-1][full]
    node = np.add.reduceat(words.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
    node = words.mix(node + counts[full].astype(np.uint64))
    short = (values >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((SAMPLES, len(full)), np.uint32)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat((short ^ _XOR[i]) * _TIMES[i], at)
    banded = samples[:BANDS * ROWS].reshape(BANDS, ROWS, len(full)).astype(np.uint64)
    bands = np.zeros((len(full), BANDS), np.uint64)
    for row in range(ROWS):
        bands = words.mix(bands * np.uint64(0x9E3779B97F4A7C15) + banded[:, row].T)
    bands = words.mix(bands + np.arange(BANDS, dtype=np.uint64))
    return counts, node, bands, odd_sketches(samples)


_ARROW_KEY = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64())])
_ARROW_SIGNED = pa.schema([
    ("row_key", _ARROW_KEY), ("n_shingles", pa.int64()), ("node", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list per text: its row, or an empty one."""
    offsets = np.concatenate(([0], np.cumsum(np.where(full, rows.shape[1], 0))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(rows.ravel().view(np.int64)))


def _signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in words.parts(batch.column(1)):
                counts, node, bands, sketches = sign(texts, size)
                full = counts > 0
                nodes = np.zeros(len(counts), np.int64)
                nodes[full] = node.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin).cast(_ARROW_KEY),
                     pa.array(counts, pa.int64()), pa.array(nodes, mask=~full),
                     _lists(bands, full), _lists(sketches, full)], schema=_ARROW_SIGNED)
    return run


def _row_key():
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"),
                    F.xxhash64("text").alias("text_hash"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two full sets are as similar as asked."""
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    values, first = words.shingle_sets(words.split(texts, lower=True), size)
    return [values[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]


def _confirmer(size: int, percent: int):
    """Pairs whose full shingle sets are as similar as asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(2), batch.column(3)
            linked = []
            for begin, end in words.batches(words.sizes(*columns)):
                left, right = (
                    _sets(c.slice(begin, end - begin).cast(pa.binary()).to_pylist(), size)
                    for c in columns)
                linked += [_similar(a, b, percent) for a, b in zip(left, right, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))
    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that are linked; ``texts`` has one text per class."""
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    own = texts.join(needed, "node", "left_semi")
    return (
        pairs.join(own.select(F.col("node").alias("u"), F.col("text").alias("left_text")), "u")
        .join(own.select(F.col("node").alias("v"), F.col("text").alias("right_text")), "v")
        .select("u", "v", "left_text", "right_text")
        .mapInArrow(_confirmer(size, percent), "u long, v long")
    )


def _block_linker(size: int, percent: int, cut: int):
    """How the components of two blocks (or of one block with itself) are linked: a forest."""
    def run(block: pa.Table) -> pa.Table:
        node, root = block.column("node").to_numpy(), block.column("root").to_numpy()
        order = np.argsort(node, kind="stable")
        root, side = root[order], block.column("side").to_numpy()[order]
        sketch = block.column("sketch").combine_chunks().flatten().to_numpy().view(
            np.uint64).reshape(len(node), BITS // 64)[order]
        pairs = []
        for i in np.flatnonzero(side != 1):
            others = np.flatnonzero((side != 0) & (root != root[i]))
            if side[i] == 2:
                others = others[others > i]
            odd = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = odd <= cut
            pairs += zip(odd[near].tolist(), [int(i)] * int(near.sum()), others[near].tolist(),
                         strict=True)
        pairs.sort()
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        texts = block.column("text")
        links = []
        for _, i, j in pairs:
            a, b = find(int(root[i])), find(int(root[j]))
            if a == b:
                continue
            for k in (i, j):
                if k not in sets:
                    text = texts[int(order[k])].as_py().encode("utf-8")
                    sets[k] = _sets([text], size)[0]
            if _similar(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                links.append((max(a, b), min(a, b)))
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()),
                         "v": pa.array([x[1] for x in links], pa.int64())})
    return run


def _mixed_blocks(buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt to pairs of blocks.

    Members of a bucket's largest component need not meet each other: its blocks meet only the
    blocks of the others, which also meet among themselves.  So a row is copied as often as the
    others have blocks, however large the component is.
    """
    labelled = buckets.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def blocks(members: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("long")

    mixed = (
        labelled.groupBy("band", "root")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
        .groupBy("band")
        .agg(F.max(F.struct("n", "s", "root")).alias("top"), F.sum("n").alias("n"),
             F.sum("s").alias("s"))
        .filter(F.col("n") > F.col("top.n"))
        .select("band", F.col("top.root").alias("top"),
                blocks(F.col("top.n"), F.col("top.s")).alias("top_blocks"),
                blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
                .alias("other_blocks"))
    )
    in_top, others = F.col("root") == F.col("top"), F.col("other_blocks")
    block = F.pmod(F.xxhash64("node"), F.when(in_top, F.col("top_blocks")).otherwise(others))
    meets = F.when(in_top, others).otherwise(F.col("top_blocks") + others)
    across = F.col("met") < F.col("top_blocks")
    met = F.col("met") - F.col("top_blocks")
    low, high = F.least("block", met), F.greatest("block", met)
    pair = (
        F.when(in_top, F.col("block") * others + F.col("met"))
        .when(across, F.col("met") * others + F.col("block"))
        .otherwise(F.col("top_blocks") * others + low * others + high)
    )
    side = (F.when(in_top, 0).when(across, 1).when(F.col("block") == met, 2)
            .when(F.col("block") == low, 0).otherwise(1))
    return (
        labelled.join(mixed, "band").withColumn("block", block)
        .withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
        .select("band", pair.alias("pair"), side.alias("side"), "node", "root")
        .join(texts, "node").select("band", "pair", "side", "node", "root", "sketch", "text")
    )


def near_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    keyed = docs.select(_row_key().alias("row_key"), "text")
    signed = reliable(keyed.mapInArrow(_signer(size), SIGNED))
    classes = reliable(
        signed.filter("node is not null").groupBy("node")
        .agg(F.min("row_key.doc_id").alias("first_id"), F.min("row_key").alias("row_key"),
             F.any_value("n_shingles").alias("n_shingles"),
             F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    sketches = classes.select("node", "sketch")
    members = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    buckets = reliable(members.join(shared.select("band", "hub"), "band"))
    active = buckets.select("node").distinct()
    chosen = classes.join(active, "node", "left_semi").select("node", "row_key", "sketch")
    texts = reliable(
        keyed.join(chosen, "row_key").dropDuplicates(["row_key"]).select("node", "sketch", "text"))

    cut = most_odd_bits(percent)
    sketches = classes.select("node", "sketch")
    odd = F.aggregate(
        F.zip_with("u_sketch", "v_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0), lambda total, n: total + n)
    stars = (
        buckets.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
        .distinct()
        .join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("u_sketch")), "u")
        .join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("v_sketch")), "v")
        .filter(odd <= cut).select("u", "v")
    )
    # Links are written out before they are contracted: a task then needs one Python worker, not two.
    labels = components(reliable(confirm(reliable(stars), texts, size, percent)))
    bridges = _mixed_blocks(buckets.drop("hub"), labels, texts).groupBy("band", "pair").applyInArrow(
        _block_linker(size, percent, cut), "u long, v long")
    bridged = components(reliable(bridges))

    rooted = (
        classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(bridged.select(F.col("node").alias("root"), F.col("root").alias("top")),
              "root", "left")
        .select("node", "first_id", F.coalesce("top", "root").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(smallest, "root").select("node", "component_id")
    return signed.join(component, "node", "left").select(
        F.col("row_key.doc_id").alias("doc_id"), F.col("row_key.text_hash").alias("text_hash"),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("row_key.doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach), kept (it is the smallest)."""
    return near_components(docs.select("doc_id", "text"), size, percent).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of near duplicates but the smallest doc_id of each group."""
    found = near_components(docs.select("doc_id", "text"), size, percent)
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")).distinct()
    return docs.join(
        dropped, docs["doc_id"].cast("long").eqNullSafe(F.col("dropped_id"))
        & (F.xxhash64(docs["text"]) == F.col("dropped_hash")), "left_anti")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, a Jaccard similarity of at least 0.8, exact links."""
    return near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), size=2, percent=80)
