"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A word's symbols form a linked list.  Leaf i of the tree holds the rank of the pair that starts at
symbol i, with i itself in the low bits, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves (the merged pair's, its left neighbour's, the swallowed symbol's), each a point
update of logarithmic cost, until the root says that no pair can be merged.  Even a word of a million
symbols takes n log n steps.  ``PairTree`` is that tree for one word; ``PairForest`` holds the trees
of many short words in arrays and merges in all of them at once.

The vocabulary file is read once on the driver and broadcast (its size is checked); texts are encoded
where they are, without a shuffle.  Workers remember the encodings of words seen, up to ``REMEMBERED``
words; that changes nothing but the time.

Defined cases: null text counts as empty and gives no tokens and an empty decoded text; special tokens
written out in a text become their ids; each row is encoded by itself, so repeated rows give equal
results; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import words
from lanewise.llm.common import table

REMEMBERED = 120_000
MAX_FILE = 64 << 20
_NO_PAIR = 1 << 62
_POSITION_BITS = 32


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairTree:
    """The symbols of one word and the segment tree over the ranks of their pairs."""

    def __init__(self, symbols: list[int], merges: dict[int, tuple[int, int]]):
        n = len(symbols)
        self.symbols, self.merges = symbols, merges
        self.next, self.previous = list(range(1, n + 1)), list(range(-1, n - 1))
        self.size = size = 1 << max(0, n - 2).bit_length()
        tree = [_NO_PAIR] * (2 * size)
        for i in range(n - 1):
            merge = merges.get(symbols[i] << 32 | symbols[i + 1])
            if merge:
                tree[size + i] = merge[0] << _POSITION_BITS | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        self.tree = tree

    def _set(self, at: int, value: int) -> None:
        tree, i = self.tree, self.size + at
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            least = value if value < other else other
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = value = least

    def _rank(self, left: int, right: int) -> int:
        merge = self.merges.get(self.symbols[left] << 32 | self.symbols[right])
        return merge[0] << _POSITION_BITS | left if merge else _NO_PAIR

    def run(self) -> list[int]:
        """Merge until no pair is left; the ids that remain, in order."""
        symbols, following, previous, tree = self.symbols, self.next, self.previous, self.tree
        n = len(symbols)
        while tree[1] != _NO_PAIR:
            at = tree[1] & (1 << _POSITION_BITS) - 1
            gone = following[at]
            symbols[at] = self.merges[symbols[at] << 32 | symbols[gone]][1]
            after = following[at] = following[gone]
            if gone < self.size:
                self._set(gone, _NO_PAIR)
            if after < n:
                previous[after] = at
                self._set(at, self._rank(at, after))
            else:
                self._set(at, _NO_PAIR)
            before = previous[at]
            if before >= 0:
                self._set(before, self._rank(before, at))
        left, at = [], 0
        while at < n:
            left.append(symbols[at])
            at = following[at]
        return left


class PairForest:
    """The trees of many words of at most ``LONGEST`` symbols, one row each."""

    LONGEST = 65

    def __init__(self, merges: dict[int, tuple[int, int]]):
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        both = np.array(list(merges.values()), np.int64).reshape(-1, 2)[order]
        self.keys, self.ranks = keys[order], both[:, 0]
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        self.merged[self.ranks] = both[:, 1]

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a leaf holds for the pair (left, right) that starts at ``at``."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place] << _POSITION_BITS | at, _NO_PAIR)

    def run(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merge in every row of ``symbols``, in place; which symbols remain."""
        n, width = symbols.shape
        size = 1 << max(0, width - 2).bit_length()
        column = np.arange(width)
        tree = np.full((n, 2 * size), _NO_PAIR)
        leaves = self._leaf(symbols[:, :-1], symbols[:, 1:], column[:-1])
        tree[:, size:size + width - 1] = np.where(
            column[1:] < length[:, None], leaves, _NO_PAIR)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree = tree.ravel()
        following = np.tile(column + 1, (n, 1)).ravel()
        previous = np.tile(column - 1, (n, 1)).ravel()
        flat, alive = symbols.reshape(-1), (column < length[:, None]).ravel()

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, i = rows * (2 * size), size + at
            tree[base + i] = value
            while size > 1 and i[0] > 1:
                i = i >> 1
                tree[base + i] = np.minimum(tree[base + 2 * i], tree[base + 2 * i + 1])

        rows = np.arange(n)
        while True:
            top = tree[rows * (2 * size) + 1]
            rows, top = rows[top != _NO_PAIR], top[top != _NO_PAIR]
            if not len(rows):
                return alive.reshape(n, width)
            at, base = top & (1 << _POSITION_BITS) - 1, rows * width
            gone = following[base + at]
            flat[base + at] = self.merged[top >> _POSITION_BITS]
            alive[base + gone] = False
            after = following[base + gone]
            following[base + at] = after
            leaf = gone < size
            if leaf.any():
                put(rows[leaf], gone[leaf], np.full(int(leaf.sum()), _NO_PAIR))
            last = after >= length[rows]
            right = np.where(last, at, after)
            put(rows, at, np.where(
                last, _NO_PAIR, self._leaf(flat[base + at], flat[base + right], at)))
            previous[(base + after)[~last]] = at[~last]
            before = previous[base + at]
            some = before >= 0
            if some.any():
                before, base, at = before[some], base[some], at[some]
                put(rows[some], before,
                    self._leaf(flat[base + before], flat[base + at], before))


class Encoding(dict):
    """word -> (ids as text, tokens as text, number of ids); ``learn`` works out those not known."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str):
        super().__init__()
        letters = byte_letters()
        self.inside = [vocabulary[letters[b]] for b in range(256)]
        self.last = [vocabulary[letters[b] + suffix] for b in range(256)]
        self.merges = {vocabulary[a] << 32 | vocabulary[b]: (rank, vocabulary[a + b])
                       for rank, (a, b) in enumerate(merges)}
        self.forest = PairForest(self.merges)
        self.tokens = {i: token for token, i in vocabulary.items()}
        self.texts = {i: str(i) for i in self.tokens}

    def _keep(self, word: str, ids: list[int]) -> None:
        self[word] = (" ".join([self.texts[i] for i in ids]),
                      " ".join([self.tokens[i] for i in ids]), len(ids))

    def learn(self, found: set[str]) -> None:
        """After this all of ``found`` are known; older words may be forgotten."""
        new = [w for w in found if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(found)
        data = [w.encode("utf-8") for w in new]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        inside, last = np.array(self.inside), np.array(self.last)
        low = 0
        for high in (1, 3, 5, 9, 17, 33, self.forest.LONGEST):
            members = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if not len(members):
                continue
            length = sizes[members]
            padded = b"".join([data[i].ljust(high, b"\0") for i in members.tolist()])
            raw = np.frombuffer(padded, np.uint8).reshape(-1, high)
            symbols = inside[raw]
            row = np.arange(len(members))
            symbols[row, length - 1] = last[raw[row, length - 1]]
            alive = (self.forest.run(symbols, length) if high > 1
                     else np.ones(symbols.shape, bool))
            ends = np.cumsum(alive.sum(axis=1)).tolist()
            ids, begin = symbols[alive].tolist(), 0
            for i, end in zip(members.tolist(), ends, strict=True):
                self._keep(new[i], ids[begin:end])
                begin = end
        for i in np.flatnonzero(sizes > self.forest.LONGEST).tolist():
            symbols = [self.inside[b] for b in data[i][:-1]] + [self.last[data[i][-1]]]
            self._keep(new[i], PairTree(symbols, self.merges).run())


class WordBpe:
    """A tokenizer file with word ends: normaliser, word pattern, merges and special tokens."""

    def __init__(self, file: bytes):
        parts = json.loads(file)
        model = parts["model"]
        self.encoding = Encoding(model["vocab"], model["merges"], model["end_of_word_suffix"])
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.parting = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        for content, i in self.special.items():
            self.encoding.tokens[i] = content

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then each character's own lower case (a capital sigma is never final)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> Iterator[list[tuple[str, str, int]]]:
        """For each whole text its encoded words, in order."""
        encoding, parted, found = self.encoding, [], set()
        for text in texts:
            pieces = self.parting.split(text) if "<|" in text else [text]
            parted.append([piece if k % 2 else self.find_words(self.normalise(piece))
                           for k, piece in enumerate(pieces)])
            for k in range(0, len(pieces), 2):
                found.update(parted[-1][k])
        encoding.learn(found)
        for pieces in parted:
            out = []
            for k, piece in enumerate(pieces):
                if k % 2:
                    out.append((str(self.special[piece]), piece, 1))
                else:
                    out += [encoding[word] for word in piece]
            yield out


_loaded: dict[str, WordBpe] = {}


def _tokenizer(file: bytes) -> WordBpe:
    """One per worker and file."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(file)
    return _loaded[key]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, decoded: [int(i) for i in ids.split()]),
    "decoded": ("string", pa.string(), lambda ids, decoded: decoded),
    "ids_sha256": ("string", pa.string(), lambda ids, decoded: _digest(ids)),
    "decoded_sha256": ("string", pa.string(), lambda ids, decoded: _digest(decoded)),
}


def _encoder(file, outputs: tuple[str, ...], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for begin, end in words.batches(words.sizes(column)):
                counts, made = [], [[] for _ in outputs]
                texts = [t or "" for t in column.slice(begin, end - begin).to_pylist()]
                for found in tokenizer.encode(texts):
                    counts.append(sum([w[2] for w in found]))
                    ids = " ".join([w[0] for w in found])
                    decoded = " ".join([w[1] for w in found])
                    for name, values in zip(outputs, made, strict=True):
                        values.append(OUTPUTS[name][2](ids, decoded))
                own = batch.slice(begin, end - begin).select(kept)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(counts, pa.int64()),
                     *(pa.array(v, OUTPUTS[n][1]) for n, v in zip(outputs, made, strict=True))],
                    names=[*own.schema.names, "n_tokens", *outputs])
    return run


def encoded(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"),
            with_text: bool = True) -> DataFrame:
    """``docs`` (with a column text) plus n_tokens and the ``outputs`` asked for: ids, the decoded
    text, and the sha256 of both (ids as decimals joined by blanks); the text itself may go."""
    with open(path, "rb") as given:
        file = given.read(MAX_FILE + 1)
    if len(file) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    docs = docs.select([c for c in docs.columns if c not in {"n_tokens", *outputs}])
    kept = [c for c in docs.columns if with_text or c != "text"]
    columns = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    columns += ["n_tokens long", *(f"{name} {OUTPUTS[name][0]}" for name in outputs)]
    sent = docs.sparkSession.sparkContext.broadcast(file)
    return docs.mapInArrow(_encoder(sent, outputs, kept), ", ".join(columns))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document, encoded and decoded; digests of both."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"),
                   ("ids_sha256", "decoded_sha256"), with_text=False)
