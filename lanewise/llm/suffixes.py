"""Suffix-array dedup: byte strings that start in more than one place.

A text is its UTF-8 bytes; a window is ``LENGTH`` consecutive bytes of one text, the head of the suffix
that starts there.  A full suffix array has a suffix per byte, far more than a shuffle of a corpus can
carry, so suffixes are sorted only where a repeat is possible:

*Tokens.*  Winnowing gives every window a token: of the ``SEED``-byte strings inside it, the one with the
smallest hash (the rightmost of equals).  Equal windows have equal tokens at equal places, so a token that
occurs once, hence every suffix that leads to it, needs no further look.  What is left are *places*: a
token and the windows that chose it.  Places whose whole neighbourhood is equal are one *context*; a
context with several places is repeated as it is, and one of them stands for all from here on.

*Range partition.*  Contexts of tokens with more than one context carry their bytes to buckets, cut by
splitters that Spark samples.  A token with up to ``FREQUENT`` contexts is in one bucket.  One with more is
cut, so buckets are of equal size however frequent a token is; its contexts go to buckets twice, in the
order of the bytes after the token (then those before, from right to left) and in that of the bytes before
it (then those after).

*Local sort.*  A bucket sorts the window suffixes of its contexts by multikey quicksort, eight bytes a key,
and compares neighbours: equal ones are repeated.  Suffixes of different tokens, or at different distances
from their token, cannot be equal; this cuts a bucket into pieces that are sorted one by one.

*Boundaries.*  Equal windows have equal bytes on either side of their token, so in both orders their contexts
lie between contexts that begin with the same bytes.  A window whose bytes on the leading side differ from
those of the bucket's first and last context (where these are of its token) has all its equals in the
bucket and is settled there.  What is settled in neither order leaves the bucket: a context has a row at
most per order.  Its windows, one of each of a bucket, are then counted by fingerprint; a fingerprint has at
most one row per bucket.

Repeated windows that overlap or touch are one span, and the bytes of spans are removed.

Hashes decide where bytes are not compared: 128 bits for rows, contexts and windows that no order settles;
64 for tokens, where a false equality only adds a place to look at.  Long texts are read in pieces of
``PIECE`` bytes whose windows do not overlap.  Texts are shuffled once, places twice (by token; by context
where the token repeats).  No step gathers the places of a context or a window, or more than ``FREQUENT``
contexts of a token.

Defined cases: null and empty texts, and texts shorter than a window, keep all their bytes; repeated rows
are places like any other, so each loses what the other holds; a null doc_id is carried; an empty table
gives an empty result; other columns are not touched.  What is kept may be no valid UTF-8, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import table

LENGTH, SEED = 200, 32
PIECE = 1 << 19
# A token with more contexts is cut into several buckets.
FREQUENT = 1 << 10
# Suffixes sorted at a time (208 bytes each), unless one token has more at one distance.
SORTED = 1 << 13

# A place in one number: the token's byte, how far before it the first window starts, and how many
# windows follow the first.
_BITS = 8
_MASK = (1 << _BITS) - 1
_OTHER = np.uint64(0x2545F4914F6CDD1D)


class _Prints:
    """Hashes of any byte strings of a buffer, from two independent sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = words._byte_powers.get(len(data) + 1)
        values = words._BYTE_VALUES
        self.sums = [self._summed(v[data]) for v in (values, words.mix(values ^ _OTHER))]

    def _summed(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=total[1:])
        return total

    def get(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total = self.sums[which]
        return words.mix((total[end] - total[begin]) * self.down[begin])

    def all_of(self, size: int) -> np.ndarray:
        """The first hash of every string of ``size`` bytes."""
        total, n = self.sums[0], len(self.sums[0]) - size
        return words.mix((total[size:] - total[:n]) * self.down[:n])


def _chosen(prints: _Prints, length: int, seed: int) -> np.ndarray:
    """The token's place of every window, whatever texts it spans."""
    hashes = prints.all_of(seed)
    bits = np.uint64(int(len(hashes)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = hashes & ~low | (low - np.arange(len(hashes), dtype=np.uint64))
    span, width = length - seed + 1, 1
    while width < span:  # the smallest of ``width`` tokens, doubling; the right one of equals
        step = min(width, span - width)
        best = np.minimum(best[step:], best[:-step])
        width += step
    return (low - (best & low)).astype(np.int64)


def _pieces(texts: list[bytes | None], length: int, size: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Joined pieces of texts, about ``size`` bytes: which texts, from where, and the bytes.

    A longer text is cut where all its copies are: at multiples of ``size``.
    """
    owners, bases, joined, held = [], [], [], 0
    for row, text in enumerate(texts):
        for base in range(0, max(len(text or b"") - length + 1, 0), size):
            piece = text[base:base + size + length - 1]
            if held and held + len(piece) > size:
                yield owners, bases, joined
                owners, bases, joined, held = [], [], [], 0
            owners.append(row)
            bases.append(base)
            joined.append(piece)
            held += len(piece)
    if joined:
        yield owners, bases, joined


_PLACES = pa.schema([(c, pa.int64()) for c in
                     ("key_a", "key_b", "place", "token", "context_a", "context_b")])


def _place_finder(length: int, seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_a, key_b = (batch.column(i).to_numpy() for i in (0, 1))
            for begin, _, texts in words.parts(batch.column(2), size):
                for owners, bases, joined in _pieces(texts, length, size):
                    sizes = np.array([len(p) for p in joined])
                    first = np.concatenate(([0], np.cumsum(sizes)))
                    prints = _Prints(np.frombuffer(b"".join(joined), np.uint8))
                    at = _chosen(prints, length, seed)
                    piece = np.repeat(np.arange(len(joined)), sizes)[:len(at)]
                    inside = np.flatnonzero(np.arange(len(at)) + length <= first[1:][piece])
                    at, piece = at[inside], piece[inside]
                    new = np.ones(len(inside), bool)
                    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
                    starts = np.flatnonzero(new)
                    low, high = inside[starts], inside[np.append(starts[1:], len(inside)) - 1]
                    at, piece = at[starts], piece[starts]
                    token = prints.get(at, at + seed, 0)
                    shape = (at - low) << _BITS | (high - low)
                    mixed = words.mix(shape.astype(np.uint64))
                    row = begin + np.array(owners)[piece]
                    place = (np.array(bases)[piece] + at - first[piece]) << 2 * _BITS | shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key_a[row]), pa.array(key_b[row]), pa.array(place),
                         pa.array(token.view(np.int64)),
                         *(pa.array((prints.get(low, high + length, i) ^ mixed).view(np.int64))
                           for i in (0, 1))], schema=_PLACES)
    return run


# What a token's contexts are ordered by: nothing, the bytes after the token, or those before it.
_WHOLE, _AFTER, _BEFORE = range(3)
_CHUNKS = pa.schema([("token", pa.binary()), ("side", pa.int64()), ("ranked", pa.binary()),
                     ("chunk", pa.binary()), ("shape", pa.int64()), ("key_a", pa.int64()),
                     ("key_b", pa.int64()), ("first", pa.int64()), ("alone", pa.bool_())])


def _chunk_finder(length: int, seed: int):
    """The bytes of the marked places of a row, in one order or in two.

    Marks are places, times 4, plus 2 if the token is frequent, plus 1 if alone.  An order holds the
    bytes around the token, so only rows without one have the chunk as well.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = [batch.column(i).to_numpy() for i in (0, 1)], batch.column(3)
            for begin, end, texts in words.parts(batch.column(2), PIECE):
                own = marks.slice(begin, end - begin)
                mark = own.flatten().to_numpy()
                row = np.repeat(np.arange(end - begin), np.diff(own.offsets.to_numpy()))
                twice = np.where(mark & 2, 2, 1)
                side = np.where(mark & 2, _AFTER, _WHOLE).repeat(twice)
                side[np.cumsum(twice)[twice == 2] - 1] = _BEFORE
                mark, row = mark.repeat(twice), row.repeat(twice)
                alone, place = (mark & 1).astype(bool), mark >> 2
                at = place >> 2 * _BITS
                low = at - (place >> _BITS & _MASK)
                ends = low + (place & _MASK) + length
                spots = list(zip(row.tolist(), at.tolist(), low.tolist(), ends.tolist(), side.tolist(),
                                 strict=True))
                for a in range(0, len(spots), 1 << 14):
                    part = spots[a:a + (1 << 14)]
                    cut = slice(a, a + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([texts[r][p:p + seed] for r, p, *_ in part], pa.binary()),
                         pa.array(side[cut]),
                         pa.array([_ranked(s, texts[r][b:p], texts[r][p + seed:e])
                                   for r, p, b, e, s in part], pa.binary()),
                         pa.array([b"" if s else texts[r][b:e] for r, _, b, e, s in part], pa.binary()),
                         pa.array(place[cut] & (1 << 2 * _BITS) - 1),
                         *(pa.array(k[begin:end][row[cut]]) for k in keys),
                         pa.array(low[cut]), pa.array(alone[cut])], schema=_CHUNKS)
    return run


def _ranked(side: int, before: bytes, after: bytes) -> bytes:
    """What a context is ordered by, among those of its token."""
    if side == _WHOLE:
        return b""
    return after + before[::-1] if side == _AFTER else before[::-1] + after


def _unranked(side: int, ranked: bytes, token: bytes, before: int) -> bytes:
    """The chunk of which ``before`` bytes are before the token."""
    if side == _AFTER:
        after = len(ranked) - before
        return ranked[after:][::-1] + token + ranked[:after]
    return ranked[:before][::-1] + token + ranked[before:]


def multikey_quicksort(keys: np.ndarray, order: np.ndarray,
                       size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``order``, segment by segment (of ``size`` rows) in the order of their ``keys``, and
    which of them equal the row before in their segment.

    A segment goes to the first key in which its rows differ; one without such a key is done.  Its rows
    are parted in three by that key of their middle row: less, equal and greater, which are segments
    again.  All segments of a round are looked at together.
    """
    order, same = order.copy(), np.zeros(len(order), bool)
    start = np.cumsum(size) - size
    while True:
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return order, same
        at, begin = _ranges(start, size), np.cumsum(size) - size
        rows, segment = order[at], np.repeat(np.arange(len(start)), size)
        pivot = rows[begin + size // 2]
        differs = keys[rows] != keys[pivot[segment]]
        depth = np.minimum.reduceat(
            np.where(differs.any(axis=1), differs.argmax(axis=1), keys.shape[1]), begin)
        equal = depth == keys.shape[1]
        same[_ranges(start[equal] + 1, size[equal] - 1)] = True
        going = ~equal[segment]
        start, size, depth, pivot = start[~equal], size[~equal], depth[~equal], pivot[~equal]
        if not len(start):
            return order, same
        at, rows, begin = at[going], rows[going], np.cumsum(size) - size
        segment = np.repeat(np.arange(len(start)), size)
        key, middle = keys[rows, depth[segment]], keys[pivot, depth][segment]
        part = (key > middle).astype(np.int64) + (key >= middle)
        order[at] = rows[np.argsort(segment * 3 + part, kind="stable")]
        size = np.bincount(segment * 3 + part, minlength=3 * len(start))
        start = np.repeat(start, 3) + np.concatenate(
            [np.zeros((len(start), 1), np.int64), np.cumsum(size.reshape(-1, 3), axis=1)[:, :2]],
            axis=1).ravel()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``size`` of them."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


# Spans have a length; contexts that a bucket did not settle have a reach (ordered by what is after the
# token) or a chunk and windows of it, of which some are open (ordered by what is before).
_FOUND = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("first", pa.int64()),
                    ("length", pa.int64()), ("reach", pa.int64()), ("shape", pa.int64()),
                    ("chunk", pa.binary()), ("windows", pa.binary()), ("open", pa.binary())])
_WINDOWS = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("first", pa.int64()),
                      ("length", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()),
                      ("open", pa.bool_())])


class _Bucket:
    """The contexts of a bucket, and their window suffixes in sorted pieces."""

    def __init__(self, batches: list[pa.RecordBatch], length: int, together: int):
        rows = pa.Table.from_batches(batches)
        token, side, ranked, chunk, shape, self.key_a, self.key_b, self.first, self.alone = (
            rows.column(c).combine_chunks() for c in _CHUNKS.names)
        self.length, self.together = length, together
        side, ranked, tokens = side.to_numpy(), ranked.to_pylist(), token.to_pylist()
        names, self.group = np.unique(
            np.array([t + bytes([s]) for t, s in zip(tokens, side.tolist(), strict=True)], dtype=object),
            return_inverse=True)
        self.side = side
        shape = shape.to_numpy()
        self.before, self.more = shape >> _BITS & _MASK, shape & _MASK
        self.after = length - len(tokens[0]) - self.before  # of the first window
        chunks = [_unranked(s, r, t, b) if s else c for s, r, t, b, c in zip(
            side.tolist(), ranked, tokens, self.before.tolist(), chunk.to_pylist(), strict=True)]
        self.data = np.frombuffer(b"".join(chunks), np.uint8)
        self.end = np.cumsum([len(c) for c in chunks])
        self.begin = np.append(0, self.end[:-1])
        self.key_a, self.key_b, self.first = (
            c.to_numpy() for c in (self.key_a, self.key_b, self.first))
        self.alone = self.alone.to_numpy(zero_copy_only=False)
        self.reach = np.full(len(chunks), -1)
        for group, edge in ((0, min), (len(names) - 1, max)):
            own = np.flatnonzero(self.group == group)
            if side[own[0]] != _WHOLE:
                other = edge(ranked[i] for i in own.tolist())
                self.reach[own] = np.maximum(self.reach[own], _common(ranked, own, other))

    def unsettled(self, context: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which windows may go on in other buckets, since their bytes on the side that leads do."""
        leading = np.where(self.side[context] == _AFTER, self.after[context] + window,
                           self.before[context] - window)
        return leading <= self.reach[context]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(context, window within it) of whole units, a token and a distance from it, and whether
        these contexts end here."""
        order = np.argsort(self.group, kind="stable")
        weight = np.cumsum((self.more + 1)[order])
        begin = 0
        while begin < len(order):
            end = int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + self.together))
            end = max(end, begin + 1)
            group = self.group[order[min(end, len(order)) - 1]]
            # whole tokens: to the end of the last one
            end = int(np.searchsorted(self.group[order], group, side="right"))
            yield from self._units(order[begin:end])
            begin = end

    def _units(self, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        if int((self.more[contexts] + 1).sum()) <= 4 * self.together:
            yield (np.repeat(contexts, self.more[contexts] + 1),
                   _ranges(np.zeros(len(contexts), np.int64), self.more[contexts] + 1), True)
            return
        last = int(self.before[contexts].max())
        for distance in range(last + 1):  # a frequent token: one distance after the other
            window = self.before[contexts] - distance
            held = (window >= 0) & (window <= self.more[contexts])
            yield contexts[held], window[held], distance == last

    def sorted(self, context: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.begin[context] + window
        padded = -(-self.length // 8) * 8
        heads = np.zeros((len(at), padded), np.uint8)
        heads[:, :self.length] = np.lib.stride_tricks.sliding_window_view(
            self.data, self.length)[at]
        unit = self.group[context] << _BITS | (self.before[context] - window)
        order = np.argsort(unit, kind="stable")
        unit = unit[order]
        ends = np.append(np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit))
        keys = heads.view(">u8").astype(np.uint64)
        return multikey_quicksort(keys, order, np.diff(ends, prepend=0))


def _common(strings: list[bytes], chosen: np.ndarray, other: bytes) -> np.ndarray:
    """How many first bytes the chosen strings have in common with another."""
    found, width = [], len(other)
    for a in range(0, len(chosen), 1 << 12):
        part = [strings[i] for i in chosen[a:a + (1 << 12)].tolist()]
        sizes = np.array([min(len(s), width) for s in part])
        heads = np.array(part, dtype=f"S{width + 1}").view(np.uint8).reshape(len(part), width + 1)
        differs = heads[:, :width] != np.frombuffer(other, np.uint8)
        differs = np.concatenate([differs, np.ones((len(part), 1), bool)], axis=1)
        found.append(np.minimum(differs.argmax(axis=1), sizes))
    return np.concatenate(found)


def _bucket_sorter(length: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        bucket = _Bucket(rows, length, together)
        rows.clear()
        held, found = [], []
        for context, window, ended in bucket.pieces():
            order, same = bucket.sorted(context, window)
            context, window = context[order], window[order]
            repeated = same.copy()
            repeated[:-1] |= same[1:]
            alone = bucket.alone[context]
            going = bucket.unsettled(context, window) & ~same & (bucket.side[context] == _BEFORE)
            held.append((context[going], window[going], (alone & ~repeated)[going]))
            found.append((context[repeated & alone], window[repeated & alone]))
            if ended:
                yield _spans(bucket, *map(np.concatenate, zip(*found, strict=True)))
                found = []
        yield from _contexts(bucket, *map(np.concatenate, zip(*held, strict=True)))
        going = np.flatnonzero((bucket.side == _AFTER) & (bucket.after <= bucket.reach))
        yield _found(bucket, going, reach=pa.array(bucket.reach[going]))
    return run


def _found(bucket: _Bucket, context: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    own = {c: pa.array(getattr(bucket, c)[context]) for c in ("key_a", "key_b", "first")} | columns
    return pa.RecordBatch.from_arrays(
        [own[f.name] if f.name in own else pa.nulls(len(context), f.type) for f in _FOUND], schema=_FOUND)


def _spans(bucket: _Bucket, context: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Windows of a context that follow each other as one span."""
    order = np.lexsort((window, context))
    context, window = context[order], window[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(context))[:len(begin)] - 1
    context, window, more = context[begin], window[begin], window[end] - window[begin]
    return _found(bucket, context, first=pa.array(bucket.first[context] + window),
                  length=pa.array(more + bucket.length))


def _contexts(bucket: _Bucket, context: np.ndarray, window: np.ndarray,
              open_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per context: its bytes, its windows, and whether these still need a twin."""
    order = np.lexsort((window, context))
    context, window, open_ = (x[order] for x in (context, window.astype(np.uint8), open_.astype(np.uint8)))
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])[:len(context)])
    end = np.append(begin[1:], len(context))[:len(begin)]
    for a in range(0, len(begin), 1 << 12):
        cuts = list(zip(begin[a:a + (1 << 12)].tolist(), end[a:a + (1 << 12)].tolist(), strict=True))
        own = context[begin[a:a + (1 << 12)]]
        yield _found(
            bucket, own, shape=pa.array(bucket.before[own] << _BITS | bucket.more[own]),
            chunk=pa.array([bucket.data[b:e].tobytes() for b, e in zip(
                bucket.begin[own].tolist(), bucket.end[own].tolist(), strict=True)], pa.binary()),
            windows=pa.array([window[b:e].tobytes() for b, e in cuts], pa.binary()),
            open=pa.array([open_[b:e].tobytes() for b, e in cuts], pa.binary()))


def _window_finder(length: int, seed: int):
    """Spans as they are, with prints of their own that keep them apart and evenly dealt; the windows
    that no order settled with their prints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(batch.column("length").is_valid())
            key_a, key_b, first, size = (
                whole.column(c).to_numpy() for c in ("key_a", "key_b", "first", "length"))
            own = words.mix(key_a.view(np.uint64)) ^ words.mix(first.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key_a), pa.array(key_b), pa.array(first), pa.array(size),
                 pa.array(own.view(np.int64)), pa.array(key_b), pa.nulls(len(size), pa.bool_())],
                schema=_WINDOWS)
            rest = batch.filter(batch.column("length").is_null())
            for a, b, chunks in words.parts(rest.column("chunk"), PIECE):
                part = rest.slice(a, b - a)
                key_a, key_b, first, shape, reach = (
                    part.column(c).to_numpy() for c in ("key_a", "key_b", "first", "shape", "other"))
                windows, open_ = (part.column(c).to_pylist() for c in ("windows", "open"))
                row = np.repeat(np.arange(b - a), [len(w) for w in windows])
                window, open_ = (np.frombuffer(b"".join(x), np.uint8) for x in (windows, open_))
                window = window.astype(np.int64)
                after = length - seed - (shape >> _BITS & _MASK)[row] + window
                going = after <= reach[row]
                row, window, open_ = row[going], window[going], open_[going].astype(bool)
                prints = _Prints(np.frombuffer(b"".join(chunks), np.uint8))
                ends = np.cumsum([len(c) for c in chunks])
                at = np.append(0, ends[:-1])[row] + window
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key_a[row]), pa.array(key_b[row]), pa.array(first[row] + window),
                     pa.array(np.full(len(row), length)),
                     *(pa.array(prints.get(at, at + length, i).view(np.int64)) for i in (0, 1)),
                     pa.array(open_)], schema=_WINDOWS)
    return run


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans; a span is first << 32 | length."""
    for batch in batches:
        ids, spans = batch.column(0), batch.column(2)
        for begin, end, texts in words.parts(batch.column(1)):
            sizes, kept, removed = [], [], []
            for text, marks in zip(texts, spans.slice(begin, end - begin).to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for mark in sorted(marks or ()):
                    first, last = mark >> 32, (mark >> 32) + (mark & 0xFFFFFFFF)
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                stays = zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(text)],
                            strict=True)
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in stays))
                removed.append([{"first": a, "last": b - 1} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(begin, end - begin), pa.array(sizes, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(removed, _SPANS)],
                names=["doc_id", "n_bytes", "kept", "removed"])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, piece: int = PIECE,
                    together: int = SORTED, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, ``kept`` (binary) and ``removed``, the
    maximal removed spans as first and last byte.

    ``length`` is from ``seed`` to 255 + ``seed``; ``piece`` bytes are read and ``together`` suffixes sorted
    at a time, and a token with more than ``frequent`` contexts may be cut, which changes no result.
    """
    if not seed <= length <= seed + _MASK:
        raise ValueError(f"length must be from {seed} to {seed + _MASK}")
    key, context = ["key_a", "key_b"], ["context_a", "context_b"]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key_a"),
                        F.xxhash64(F.lit(1), "text", "doc_id").alias("key_b"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = keyed.select(*key, "text").mapInArrow(
        _place_finder(length, seed, piece), ", ".join(f"{f.name} long" for f in _PLACES)
    ).filter(" and ".join(f"{f.name} is not null" for f in _PLACES))  # always true
    repeated = places.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeded = places.join(repeated.select("token"), "token")
    contexts = seeded.groupBy(*context).agg(
        F.count(F.lit(1)).alias("n"), F.min("token").alias("token"),
        F.min(F.struct(*key, "place")).alias("one"),
    ).filter("n > 0 and one is not null and token is not null"  # always true, so that one
             " and context_a is not null and context_b is not null")  # exchange serves all uses
    mixed = contexts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")

    def span(first, size):
        return F.shiftleft(first, 32).bitwiseOR(size)

    at = F.shiftright("place", 2 * _BITS)
    before = F.shiftright("place", _BITS).bitwiseAND(F.lit(_MASK))
    more = F.col("place").bitwiseAND(F.lit(_MASK))
    whole = seeded.join(contexts.filter("n > 1").select(*context), context).select(
        *key, span(at - before, more + length).alias("span"))

    marks = (
        contexts.join(mixed, "token")
        .select("one.key_a", "one.key_b",
                (F.col("one.place") * 4 + (F.col("c") > frequent).cast("long") * 2
                 + (F.col("n") == 1).cast("long")).alias("mark"))
        .groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    )
    chunks = (
        keyed.join(marks, key).select(*key, "text", "marks", "doc_id")  # doc_id: one exchange for both
        .mapInArrow(_chunk_finder(length, seed),
                    "token binary, side long, ranked binary, chunk binary, shape long, key_a long, "
                    "key_b long, first long, alone boolean")
    )
    found = chunks.repartitionByRange("token", "side", "ranked").mapInArrow(
        _bucket_sorter(length, together),
        "key_a long, key_b long, first long, length long, reach long, shape long, chunk binary, "
        "windows binary, open binary")
    other = F.max("reach").over(Window.partitionBy(*key, "first"))  # of one context
    windows = found.withColumn("other", other).filter(
        "length is not null or chunk is not null and other is not null").mapInArrow(
        _window_finder(length, seed),
        "key_a long, key_b long, first long, length long, print_a long, print_b long, open boolean")
    twins = F.count("open").over(Window.partitionBy("print_a", "print_b"))  # a row per bucket at most
    part = windows.withColumn("n", twins).filter("open is null or open and n > 1").select(
        *key, span(F.col("first"), F.col("length")).alias("span"))

    spans = whole.union(part).groupBy(*key).agg(F.collect_set("span").alias("spans"))
    return keyed.join(spans, key, "left").select("doc_id", "text", "spans").mapInArrow(
        _remover, "doc_id long, n_bytes long, kept binary, removed array<struct<first:bigint,last:bigint>>")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    found = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"),
                       lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


# A suffix per byte is beyond list functions of SQL; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
