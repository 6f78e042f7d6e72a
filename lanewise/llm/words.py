"""Words of many texts as arrays, hashed without a Python loop over the words.

Texts are UTF-8 bytes.  All separators and all letters that are lower-cased are ASCII, so working on
bytes gives the same words as working on characters.  Hashes are 64-bit polynomials over the bytes
(then over the words) modulo 2**64, finished by a bijective mixer; the constants below fix them for
all workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
# Bytes of one working array: what the tokeniser holds at a time is a small multiple of this.
SEGMENT = 1 << 20

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD95)


def separators(kept: bytes | None = None) -> np.ndarray:
    """Which bytes part words: white space, or every ASCII byte outside ``kept``."""
    if kept is None:
        table = np.zeros(256, bool)
        table[list(SPACES)] = True
    else:
        table = np.arange(256) < 128
        table[list(kept)] = False
    return table


WHITE_SPACE = separators()
NOT_ALPHANUMERIC = separators(b"0123456789abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, inverse = int(base), pow(int(base), -1, 1 << 64)
        self.steps = (np.uint64(self.base), np.uint64(inverse))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, step, np.uint64))))
                for step in self.steps)
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Words(NamedTuple):
    """Words of several texts, one after the other.

    ``first[d]`` to ``first[d + 1]`` are the words of text ``d``; ``start`` and ``end`` are their
    places in ``buffer``.
    """

    buffer: bytes
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _segments(buffer: bytes, is_separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts right after a separator; a segment only grows beyond SEGMENT for a longer word."""
    begin, n = 0, len(buffer)
    parting = bytes(np.flatnonzero(is_separator).astype(np.uint8))
    while begin < n:
        end = min(begin + SEGMENT, n)
        while end < n and buffer[end - 1] not in parting:
            end += 1
        yield begin, end
        begin = end


def split(texts: list[bytes], is_separator: np.ndarray = WHITE_SPACE, lower: bool = False) -> Words:
    """The words of ``texts``; None counts as empty."""
    parts = [t or b"" for t in texts]
    buffer = b"\n".join(parts) + b"\n" if parts else b""
    if lower:
        buffer = buffer.translate(LOWER)
    found = []
    for begin, end in _segments(buffer, is_separator):
        data = np.frombuffer(buffer, np.uint8, end - begin, begin)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~is_separator[data]
        edges = np.diff(inside)
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = _byte_powers.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
        found.append((mix((sums[stop] - sums[start]) * down[start]), start + begin, stop + begin))
    if found:
        hashes, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        hashes, start, stop = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in parts], dtype=np.int64)))
    return Words(buffer, hashes, start, stop, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words, whatever texts they belong to."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _word_powers.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and where each text's begin.

    A text with fewer words than ``size`` has its whole sequence as its one shingle; a text without
    words has none.
    """
    counts = np.diff(words.first)
    texts = np.arange(len(counts))
    shingles = windows(words.hashes, size)
    owner = words.text_of[:len(shingles)]
    whole = np.arange(len(shingles)) + size <= words.first[1:][owner]
    pieces, owners = [shingles[whole]], [owner[whole]]
    for n in range(1, size):
        short = texts[counts == n]
        if len(short):
            pieces.append(windows(words.hashes, n)[words.first[short]])
            owners.append(short)
    values, owner = np.concatenate(pieces), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def sizes(*columns: pa.Array) -> list[int]:
    """Bytes of text in each row, without turning the texts into Python objects."""
    found = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in columns]
    return sum(found).tolist() if found else []


def batches(texts: Sequence[bytes | int | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts, given as such or by their sizes, that hold about ``limit`` bytes together,
    or one longer text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = 1 + (text if isinstance(text, int) else len(text or b""))
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def parts(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """A column of texts in such ranges: only one range at a time is held as Python objects."""
    for begin, end in batches(sizes(column), limit):
        yield begin, end, column.slice(begin, end - begin).cast(pa.binary()).to_pylist()
