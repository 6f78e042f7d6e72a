"""Ranked lexical search: for every item the ``TOP`` documents with the highest scores, LEMP's way.

A document is the vector of its terms' impacts, an item that of its terms' weights (times their
repeats), a score their inner product.

1. *Terms.*  One pass over the texts gives each document's length and how often it holds each term of the
   items: the vector's raw form, an order of magnitude smaller than the texts, written to the shared folder.
   Counts of documents, of all terms and of documents per term are aggregations over it.
2. *Norm buckets.*  Tasks read the vectors in blocks, order a block by norm and cut it into buckets.
   By Cauchy-Schwarz a bucket whose largest norm times the item's norm is below the item's lowest kept
   score cannot change it, nor can any later bucket of the block.
3. *Coordinate bounds.*  In a bucket, an item's heaviest coordinates (``FOCUS`` of its squared norm)
   are multiplied out; Cauchy-Schwarz on what both vectors have left bounds the rest.  Documents below
   the lowest kept score are out.
4. *Rescoring.*  Survivors get their exact score from all coordinates, in 64-bit integers.  Bounds are
   doubles, widened by a billionth, so rounding drops nobody.

Lowest kept scores start from a first round over every so many documents (by hash, about ``FIRST`` of them
whatever the corpus's size); they are scores of real documents, so a start too low costs time and nothing
else.  A task hands on at most ``TOP`` documents per item and those of equal score; a window with early
limit merges them.

Items are the queries: they go round in blocks of ``BLOCK_TERMS`` terms, each broadcast within that bound
and met by all documents in one pass; the number of passes grows with the benchmark.  Terms are told
apart by 64-bit hashes; a false equality needs a corpus word to hit one of a block's terms.

Defined cases: null and wordless texts hold nothing, find nothing and are not counted among the
documents; a document's repeated rows rank as documents of their own; documents without an id come last
among equals; repeated items are ranked each by itself; empty tables give an empty result; other columns
are not touched.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import LOWER, UPPER, reliable, table
from lanewise.session import shared_dir

TOP = 20
BLOCK_TERMS = 1 << 18
FIRST = 1 << 12
FOCUS = 0.8
# Documents held and ordered at a time, and those of a bucket.
BLOCK_DOCS, BUCKET = 1 << 13, 1 << 10
_SLACK = 1 + 1e-9


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's terms as hashes, with repeats."""
    for batch in batches:
        for begin, end, texts in words.parts(batch.column(1)):
            split = words.split(texts, words.NOT_ALPHANUMERIC, lower=True)
            hashes = [split.hashes[a:b].tobytes() for a, b in
                      zip(split.first[:-1], split.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin).cast(pa.int64()),
                 pa.array(hashes, pa.binary())], names=["item_id", "terms"])


_VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                     ("counts", pa.list_(pa.int32()))])


def _vector_finder(sent: Broadcast):
    """(doc_id, n, terms, counts) of documents with words; terms are places in the sorted vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for begin, end, texts in words.parts(batch.column(1)):
                split = words.split(texts, words.NOT_ALPHANUMERIC, lower=True)
                n = np.diff(split.first)
                at = np.searchsorted(vocabulary, split.hashes)
                at[at == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[at] == split.hashes)
                pairs = split.text_of[known] * len(vocabulary) + at[known]
                pairs, counts = np.unique(pairs, return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(end - begin + 1) * len(vocabulary))
                offsets = pa.array(offsets, pa.int32())
                terms = pa.array(pairs % len(vocabulary), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, terms),
                     pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                    schema=_VECTOR).filter(pa.array(n > 0))
    return run


class Items:
    """A block of items: their terms (places in the vocabulary), and integer coordinates."""

    def __init__(self, ids: list[int | None], terms: list[np.ndarray], weights: np.ndarray):
        self.ids = ids
        self.terms, self.values, self.focus, self.norm = [], [], [], []
        for own in terms:
            term, repeats = np.unique(own, return_counts=True)
            value = weights[term] * repeats
            order = np.argsort(-value, kind="stable")
            term, value = term[order], value[order]
            squares = np.cumsum(value.astype(float) ** 2)
            total = squares[-1] if len(squares) else 0.0
            self.terms.append(term)
            self.values.append(value)
            self.focus.append(int(np.searchsorted(squares, FOCUS * total)) + 1)
            self.norm.append(math.sqrt(total))
        self.rest = [math.sqrt(max(0.0, n * n - float((v[:f].astype(float) ** 2).sum())))
                     for n, v, f in zip(self.norm, self.values, self.focus, strict=True)]


class Bucket:
    """Documents of similar norm; ``term`` sorted, so that a term's postings lie together."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray,
                 norm: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.row, self.impact, self.norm, self.n = row[order], impact[order], norm, n
        self.names, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(term))

    def _postings(self, terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.names):
            return self.row[:0], self.impact[:0], values[:0]
        at = np.searchsorted(self.names, terms)
        at[at == len(self.names)] = 0
        held = self.names[at] == terms
        begin, size = self.first[at[held]], (self.last - self.first)[at[held]]
        place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return self.row[place], self.impact[place], np.repeat(values[held], size)

    def best(self, items: Items, item: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may reach ``lowest``, with their exact scores."""
        terms, values, f = items.terms[item], items.values[item], items.focus[item]
        row, impact, value = self._postings(terms[:f], values[:f])
        part = np.zeros(self.n, np.int64)
        np.add.at(part, row, impact * value)
        squares = np.bincount(row, impact.astype(float) ** 2, self.n)
        rest = np.sqrt(np.maximum(self.norm ** 2 - squares, 0.0)) * items.rest[item]
        stays = (part + rest) * _SLACK >= lowest
        row, impact, value = self._postings(terms[f:], values[f:])
        wanted = stays[row]
        np.add.at(part, row[wanted], (impact * value)[wanted])
        found = np.flatnonzero(stays & (part > 0) & (part >= lowest))
        return found, part[found]


class Kept:
    """The best documents of every item so far, and the lowest score that still matters."""

    def __init__(self, lowest: list[int], top: int):
        self.top, self.lowest = top, list(lowest)
        self.scores = [np.zeros(0, np.int64) for _ in lowest]
        self.ids = [np.zeros(0, np.int64) for _ in lowest]
        self.known = [np.zeros(0, bool) for _ in lowest]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores = np.concatenate((self.scores[item], scores))
        ids = np.concatenate((self.ids[item], ids))
        known = np.concatenate((self.known[item], known))
        order = np.lexsort((ids, ~known, -scores))[:self.top]
        self.scores[item], self.ids[item], self.known[item] = scores[order], ids[order], known[order]
        if len(order) == self.top:
            self.lowest[item] = max(self.lowest[item], int(self.scores[item][-1]))


_FOUND = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()),
                    ("score", pa.int64())])


def _searcher(sent: Broadcast, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, documents, total, lowest = sent.value
        kept = Kept(lowest, top)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_DOCS):
                _search(batch.slice(begin, BLOCK_DOCS), items, documents, total, kept)
        for item, (scores, ids, known) in enumerate(zip(kept.scores, kept.ids, kept.known,
                                                        strict=True)):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item)),
                     pa.array([items.ids[item]] * len(scores), pa.int64()),
                     pa.array(ids, mask=~known), pa.array(scores)], schema=_FOUND)
    return run


def _search(block: pa.RecordBatch, items: Items, documents: int, total: int, kept: Kept) -> None:
    known = np.asarray(block.column(0).is_valid())
    ids = block.column(0).fill_null(0).to_numpy()
    n = block.column(1).to_numpy()
    terms, counts = block.column(2), block.column(3)
    size = np.diff(terms.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), size)
    term = terms.flatten().to_numpy()
    tf = counts.flatten().to_numpy().astype(np.int64)
    m = 100 - 25 + 25 * n * documents // total
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
    norm = np.sqrt(np.bincount(row, impact.astype(float) ** 2, len(n)))
    order = np.argsort(-norm, kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    spot = place[row]
    by = np.argsort(spot, kind="stable")
    spot, term, impact = spot[by], term[by], impact[by]
    for begin in range(0, len(n), BUCKET):
        end = min(begin + BUCKET, len(n))
        norms = norm[order[begin:end]]
        reach = norms[0] * _SLACK
        wanted = [i for i, own in enumerate(items.norm) if own and own * reach >= kept.lowest[i]]
        if not wanted:
            break  # all later norms are smaller
        a, b = np.searchsorted(spot, (begin, end))
        bucket = Bucket(end - begin, spot[a:b] - begin, term[a:b], impact[a:b], norms)
        for item in wanted:
            found, scores = bucket.best(items, item, kept.lowest[item])
            if len(found):
                mine = order[begin + found]
                kept.add(item, scores, ids[mine], known[mine])


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def best_documents(docs: DataFrame, benchmark: DataFrame, top: int = TOP,
                   block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best rows of ``docs`` (doc_id, text) for each row of
    ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    sets = reliable(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInArrow(_item_terms, "item_id long, terms binary")
        .filter(F.octet_length("terms") > 0))
    size = sets.agg(F.sum(F.octet_length("terms") / 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_terms))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(blocks):
        block = sets.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == number)
        rows = block.collect()  # within the bound of a block
        if rows:
            terms = [np.frombuffer(bytes(r.terms), np.uint64) for r in rows]
            best = _block(spark, given, [r.item_id for r in rows], terms, top)
            if best is not None:
                found = found.union(best.select("item_id", "rank", "doc_id", "score"))
    return found


def _block(spark: SparkSession, given: DataFrame, ids: list[int | None], terms: list[np.ndarray],
           top: int) -> DataFrame | None:
    """Ranks of one block of items, or None if no document has a word.

    The vectors stay in the shared folder, since the result is read from them.
    """
    context = spark.sparkContext
    vocabulary = np.unique(np.concatenate(terms))
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    given.mapInArrow(
        _vector_finder(context.broadcast(vocabulary)),
        "doc_id long, n long, terms array<int>, counts array<int>").write.parquet(folder)
    vectors = spark.read.parquet(folder)
    documents, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for term, held in (vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
                       .collect()):  # a row per term of the block
        df[term] = held
    weights = np.array([_weight(documents, int(held)) for held in df])
    items = Items(ids, [np.searchsorted(vocabulary, own) for own in terms], weights)

    def search(rows: DataFrame, lowest: list[int]) -> DataFrame:
        sent = context.broadcast((items, documents, total, lowest))
        return _ranked(rows.mapInArrow(
            _searcher(sent, top), "item long, item_id long, doc_id long, score long"), top)

    lowest = [0] * len(terms)
    every = documents // FIRST
    if every > 1:
        some = vectors.filter(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(every)) == 0)
        for r in search(some, lowest).filter(F.col("rank") == top).collect():  # a row per item
            lowest[r.item] = r.score
    return search(vectors, lowest)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return best_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = {"op12_ranked_search": rf"""
    WITH split AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents),
    corpus AS (
        SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM split WHERE len(words) > 0),
    item AS (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
        FROM benchmark),
    held AS (
        SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(words) AS w FROM split)
        WHERE w IN (SELECT w FROM item) GROUP BY r, w),
    weight AS (
        SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * n + 1)))::BIGINT AS weight
        FROM (SELECT w, count(*) AS n FROM held GROUP BY w), corpus),
    scored AS (
        SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
               sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (
                   100 - 25 + ((25 * len(words) * docs) // total)))))::BIGINT AS score
        FROM item JOIN held USING (w) JOIN weight USING (w) JOIN split USING (r), corpus
        GROUP BY i, r),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""}
