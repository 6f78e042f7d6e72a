"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A text is parsed
greedily into phrases, each the longest string that occurs somewhere in the language's sample: the
automaton follows the text until it cannot go on, which ends a phrase (a letter that the sample does
not hold opens the next one).  The sample that resembles the text most gives long matches, hence few
phrases.  Counts are normalised by the logarithm of the
sample's length (c phrases cost about c * log2 n bits) and by the text's length; the language needing
fewest normalised phrases wins, ties going to the alphabetically first.

Texts are reduced to lower-case letters with one blank between words, cut into blocks of ``BLOCK``
characters (a phrase never crosses a block, the same for every language), and all blocks of a batch
are parsed side by side, one character of each at a time, for all languages at once.  Every character
of every text is parsed.

Bounds: ``PIECES`` pieces of ``PIECE`` characters per language are sampled for learning, chosen by a
hash of id and text, so 64 KB of text per language reach the driver and, broadcast, the workers, which
build the automata.  Every letter of the samples takes part.  Nothing else is bounded: a worker's table
grows with the number of languages, and one that outgrows the 31 bits of an offset (several hundred
languages) is an error.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything if
nothing is labelled; rows with null id or null lang are predicted but null langs are never learned;
repeated rows get equal results; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import held_out, table

PIECES, PIECE = 256, 256
BLOCK = 2048
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
DENSE = 62  # letters with a column in the table of steps; steps by rarer ones are kept sparsely

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_END = np.uint32(1 << 31)


def letters(text: str) -> str:
    """Lower-case letters, one blank between words and at both ends; empty without a letter."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    return f" {found} " if found and regex.search(r"\p{L}", found) else ""


class SuffixAutomaton:
    """All substrings of a sequence of codes; a code of -1 is a gap that no match crosses."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for code in codes:
            last = self._extend(last, code) if code >= 0 else 0

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, code: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:  # after a gap the string may have been seen
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, code)
        now = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][code]
            self.link[now] = (q if self.length[q] == self.length[p] + 1
                              else self._clone(p, q, code))
        return now


class Languages:
    """The automata of all languages in one table of steps.

    ``steps[state + code]`` is the next state (as an offset into the table); where the automaton
    cannot go on, the state after a new phrase began with the code, marked by ``_END``.

    Every letter of the samples has a code.  The ``DENSE`` commonest have columns, the next code is that
    of letters no sample holds, and the rest are rare letters: ``after`` has their steps, in the order of
    ``keys`` (state and letter), and ``begin`` the states after a new phrase, by language and letter.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        counts: dict[str, int] = {}
        for pieces in samples.values():
            for piece in pieces:
                for letter in piece:
                    counts[letter] = counts.get(letter, 0) + 1
        chosen = sorted(counts, key=lambda x: (-counts[x], x))
        self.other = min(DENSE, len(chosen))
        self.width, self.rare = self.other + 1, len(chosen) - self.other
        code = {letter: i + (i >= self.other) for i, letter in enumerate(chosen)}
        self.codes = np.full(max(map(ord, chosen), default=0) + 2, self.other,
                             np.min_scalar_type(len(chosen)))
        for letter, i in code.items():
            self.codes[ord(letter)] = i
        parts, self.roots, self.bits, offset = [], [], [], 0
        keys, afters = [], []
        self.begin = np.zeros((len(self.names), self.rare), np.uint32)
        for k, name in enumerate(self.names):
            sequence = []
            for piece in samples[name]:
                sequence += [code[x] for x in piece] + [-1]
            automaton = SuffixAutomaton(sequence)
            n, width = len(automaton.next), self.width
            if offset + n * width >= int(_END):
                raise ValueError(f"{len(self.names)} languages need more steps than 31 bits can number")
            root = np.full(width, offset, np.uint32)
            self.begin[k] = offset
            for c, state in automaton.next[0].items():
                if c < width:
                    root[c] = offset + state * width
                else:
                    self.begin[k, c - width] = offset + state * width
            steps = np.tile(root | _END, (n, 1))
            for state, following in enumerate(automaton.next):
                for c, after in following.items():
                    if c < width:
                        steps[state, c] = offset + after * width
                    else:
                        keys.append((offset + state * width) * self.rare + c - width)
                        afters.append(offset + after * width)
            parts.append(steps.ravel())
            self.roots.append(offset)
            self.bits.append(math.log2(len(sequence) + 2))
            offset += n * width
        self.steps = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.begin |= _END
        self.keys = np.array(keys, np.uint64)
        order = np.argsort(self.keys)
        self.keys, self.after = self.keys[order], np.array(afters, np.uint32)[order]

    def _rare_steps(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The steps (languages x lanes) by rare letters."""
        key = state.astype(np.uint64) * np.uint64(self.rare) + letter.astype(np.uint64)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.after[place], self.begin[:, letter])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases (texts x languages) of texts of letters."""
        found = np.zeros((len(texts), len(self.names)), np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = self.codes[np.minimum(points, len(self.codes) - 1)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner) or not self.names:
            return found
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * BLOCK
        length = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        width = int(length[0])
        lanes = np.zeros((width, len(owner)), self.codes.dtype)
        for lane, (a, n) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
            lanes[:n, lane] = codes[a:a + n]
        active = np.searchsorted(-length, -np.arange(1, width + 1), side="right")
        state = np.repeat(np.array(self.roots, np.uint32)[:, None], len(owner), axis=1)
        counts = np.ones(state.shape, np.uint32)
        for t in range(width):
            n = int(active[t])
            if self.rare:
                letter = lanes[t, :n]
                step = self.steps[state[:, :n] + np.minimum(letter, self.other)]
                at = np.flatnonzero(letter > self.other)
                if len(at):
                    step[:, at] = self._rare_steps(state[:, at], letter[at] - self.width)
            else:
                step = self.steps[state[:, :n] + lanes[t, :n]]
            counts[:, :n] += step >> np.uint32(31)
            state[:, :n] = step & ~_END
        for language in range(len(self.names)):
            found[:, language] = np.bincount(owner, counts[language], len(texts))
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and how much cheaper than the next best it parses."""
        reduced = [letters(t or "") for t in texts]
        cost = self.phrases(reduced) * np.array(self.bits)
        names, scores = [], []
        for text, row in zip(reduced, cost, strict=True):
            if not text or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            names.append(self.names[best])
            others = np.delete(row, best)
            scores.append(float(1 - row[best] / others.min()) if len(others) else 1.0)
        return names, scores


def sampled(labelled: DataFrame) -> dict[str, list[str]]:
    """At most ``PIECES`` pieces of ``PIECE`` characters per language of (doc_id, lang, text).

    One count per language sets the share of rows whose hash of id and text is low enough, and the
    row with the lowest is always among them; equal rows count as one, so about twice ``PIECES`` rows
    per language are collected however ids and rows repeat.  The pieces lie at a hashed place of the text.
    """
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 40))
    labelled = labelled.filter("lang is not null and text is not null").withColumn("draw", draw)
    counts = labelled.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return {}
    limit = F.create_map(*(F.lit(x) for r in counts for x in (
        r.lang, max(r.least, int(min(1.0, 2.0 * PIECES / r.n) * (1 << 40))))))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"),
                   F.greatest(F.char_length("text") - PIECE, F.lit(1))).cast("int")
    rows = labelled.filter(F.col("draw") <= limit[F.col("lang")]).select(
        "lang", "draw", F.substring(F.col("text"), place + 1, F.lit(PIECE)).alias("piece")).distinct()
    found: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.draw, r.piece)):
        pieces = found.setdefault(r.lang, [])
        piece = letters(r.piece)
        if piece and len(pieces) < PIECES:
            pieces.append(piece)
    return found


_built: dict[int, Languages] = {}


def _languages(samples: dict[str, list[str]]) -> Languages:
    """One per worker and set of samples."""
    key = zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))
    if key not in _built:
        _built.clear()
        _built[key] = Languages(samples)
    return _built[key]


def _predictor(samples):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages(samples.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for begin, end in words.batches(words.sizes(column)):
                own = batch.slice(begin, end - begin)
                names, scores = languages.predict(column.slice(begin, end - begin).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*own.schema.names, "lang_pred", "score"])
    return run


def predicted(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """``docs`` (with a column text) plus lang_pred and score."""
    docs = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    return docs.mapInArrow(_predictor(sent), f"{columns}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from."""
    return docs.select("doc_id", "lang", "text").filter(
        held_out(F.col("doc_id"), FOLDS) != HELD_OUT)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from the folds not held out."""
    samples = sampled(training_rows(table(spark, sf_dir, "documents", "doc_id", "lang", "text")))
    return predicted(table(spark, sf_dir, "documents", "doc_id", "text"), samples).select(
        "doc_id", (held_out(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred", "score")
