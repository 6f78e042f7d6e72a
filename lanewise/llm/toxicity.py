"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a text word by word:

* *insult*: a trie over the beginnings of words (and whole words), with learned weights;
* *threat*: sequences of inflected words such as "kill ... you", with up to ``INSERTED`` words between
  two of them, of the fixed weight ``THREAT``;
* *target*: a person is spoken to or of in the clause;
* *negation*: a negated word does not hurt for the next few words;
* *reported speech*: from "he said" on, the clause is somebody else's.

Their composition is one automaton whose state says what holds at a word; an insult or threat emits its
weight under that state, a threat under all that held at one of its words.  End marks of clauses and line
breaks are symbols, too: they begin a new clause, but a threat goes on over a single line break.  Words
are parted at apostrophes ("l'idiot", "you'll"), but for the English "n't".

A text's features are made of what the automaton emits and of nothing else: sums of weights that are
plain, targeted, negated or reported; the sum, density and maximum of those that are asserted (plain or
targeted); how many clauses emit, and the number of words.

What is learned, all from labelled rows of the folds not held out and all from a sample of at most
about ``TRAINING_ROWS`` rows, half of either label, drawn by a hash of id and text (equal rows count as
one): the insult trie (beginnings of words, and whole words of up to 24 letters, that occur in far more
toxic than other texts, by a likelihood ratio) and the weights of the features (logistic regression; the
constant is set right for the labels' shares before the draw).  The model is bounded, too: a beginning must be
in ``LEAST_SHARE`` (1 %) of the toxic sample rows, and the trie has ``MOST_ARCS`` (4,000) arcs at most.
Counting runs on the executors; the counts of word beginnings found in enough toxic sample rows, and one
row of features per sample row, reach the driver.

Scoring reads every word of every whole text once, and keeps the automaton's state only.  States are made
when a text first needs them; there are finitely many, and ``MOST_STATES`` are kept before they are made
anew.

Defined cases: null, empty and wordless texts match nothing and get the score of such texts; without
labelled rows of both kinds the prior lexicon and weights are used; repeated rows get equal scores; a
null id is scored; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import held_out, reliable, table

TRAINING_ROWS = 12_000
LEAST_TEXTS, LEAST_SHARE = 6, 0.01  # toxic sample rows that must hold a word's beginning
LEAST_RATIO = 30.0  # twice the log likelihood ratio
SHORTEST, LONGEST = 3, 9  # letters of a word's beginning
MOST_ARCS = 4_000
FOLDS, HELD_OUT = 3, 1
TOXIC = 0.7

# Words of the grammar's closed classes, in four languages.
TARGETS = frozenset(
    "you your yours yourself u he him she her they them these those everyone people "
    "du dich dir dein deine ihr euch sie er "
    "tu toi te vous votre ton il elle ils elles "
    "tú ti usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset(
    "not no never none nobody without isn't aren't don't doesn't wasn't "
    "nicht kein keine nie niemals ohne pas jamais sans aucun nunca jamás sin ningún".split())
REPORTS = frozenset(
    "said says say told tells called calls claimed claims wrote writes quoted quote reported "
    "sagte sagt behauptet schrieb nannte dit disait affirme écrit appelé dijo dice afirma escribió "
    "llamó".split())
INSULTS = "idiot stupid moron scum trash pathetic loser worthless disgusting clown".split()
# Threats, each a sequence of classes of words.
_YOU = "you u ya yall yourself yourselves"
_DICH = "dich euch"
THREATS = tuple(tuple(frozenset(part.split()) for part in threat) for threat in (
    ("kill kills killed killing hurt hurts hurting beat beats beaten beating destroy destroys destroyed "
     "destroying murder murders murdered murdering", _YOU),
    ("find finds finding", _YOU, "and"),
    (_YOU, "will ll shall gonna", "die pay"),
    (_YOU, "are re r", "dead"),
    ("bring bringe bringen bringt brachte", _DICH, "um"),
    (_DICH, "umbringen umbringe umzubringen töten töte"),
    ("töte töten tötet", _DICH),
    ("mach mache machen macht", _DICH, "fertig"),
    (_DICH, "fertigmachen fertigzumachen"),
    ("te t vous", "tuer tue tuerai tuerons tuons"),
    ("vais va allons", "te vous", "frapper"),
    ("te vous", "frapperai frapperons"),
    ("te os", "voy vamos", "a", "matar"),
    ("te os", "mataré mataremos mato"),
    ("voy vamos", "a", "matarte mataros pegarte pegaros"),
    ("te os", "voy vamos", "a", "pegar")))
INSERTED = 2  # words that may stand between two words of a threat
THREAT = 3.0
MOST_STATES, MOST_WORDS = 100_000, 200_000  # kept by a worker; more are made anew

_WORD = re.compile(r"[^\W_]+(?:['’]t\b)?")
_TOKEN = re.compile(_WORD.pattern + r"|\n\s*?\n|\n|[.!?;:。！？；：｡؟।]")
_NOTHING: frozenset[str] = frozenset()
PLAIN, TARGETED, NEGATED, REPORTED = range(4)


class Transducer(NamedTuple):
    """``step[state, kind]`` is the next state for a word of that kind, else ``step[state, None]``;
    ``says[state]`` is what holds at a word read in that state."""

    step: dict[tuple[int, str | None], int]
    says: dict[int, str]


def insult() -> Transducer:
    return Transducer({(0, "insult"): 1, (1, "insult"): 1, (0, None): 0, (1, None): 0},
                      {0: "", 1: "insult"})


def target() -> Transducer:
    return Transducer({(0, "target"): 1, (0, None): 0, (1, None): 1}, {0: "", 1: "target"})


def negation(reach: int = 3) -> Transducer:
    """State k: a negation stands k words back at most ``reach``."""
    step = {(k, "negation"): 1 for k in range(reach + 1)}
    step |= {(k, None): (k + 1) % (reach + 1) if k else 0 for k in range(reach + 1)}
    return Transducer(step, {0: ""} | {k: "negation" for k in range(1, reach + 1)})


def reported() -> Transducer:
    return Transducer({(0, "report"): 1, (0, None): 0, (1, None): 1}, {0: "", 1: "report"})


PARTS = {"insult": insult(), "target": target(), "negation": negation(), "report": reported()}


class Begun(NamedTuple):
    """A threat whose first ``done`` words were read, the last of them ``gap`` words ago."""

    threat: int
    done: int
    gap: int
    held: frozenset[str]  # what held at one of its words


def threatened(begun: frozenset[Begun], word_of: frozenset[tuple[int, int]],
               holds: frozenset[str]) -> tuple[frozenset[Begun], list[frozenset[str]]]:
    """The threat transducer's step: it reads what the others say at a word, and where in threats the
    word may stand; the threats begun after it, and what held at those that it ends."""
    after, ended = set(), {}
    for item in (*begun, *(Begun(threat, 0, 0, _NOTHING) for threat, at in word_of if at == 0)):
        if (item.threat, item.done) in word_of:
            held = item.held | holds
            if item.done + 1 == len(THREATS[item.threat]):
                ended.setdefault(item.threat, []).append(held)
            else:
                after.add(Begun(item.threat, item.done + 1, 0, held))
        if item.done and item.gap < INSERTED:
            after.add(item._replace(gap=item.gap + 1))
    return (frozenset(x for x in after if x.threat not in ended),
            [held for found in ended.values() for held in found])


def case(holds: frozenset[str]) -> int:
    return (REPORTED if "report" in holds else NEGATED if "negation" in holds
            else TARGETED if "target" in holds else PLAIN)


CLAUSE_END, LINE_BREAK = 0, 1


class Composed:
    """The product of the five transducers, its states made as they are needed.

    A symbol is all that the transducers can tell of a word: its kinds, and its places in threats.
    ``step(state, symbol)`` is the next state; ``emits[state]`` is None, or the cases under which an
    insult and a threat are emitted there (None for none).
    """

    def __init__(self):
        self.symbols: dict = {"end": CLAUSE_END, "break": LINE_BREAK}
        self.known = [(_NOTHING, _NOTHING)] * 2
        self.clear()

    def clear(self) -> None:
        self.number, self.tuples, self.rows, self.emits = {}, [], [], []
        self._state((0,) * len(PARTS), _NOTHING, None)

    def _state(self, plain: tuple[int, ...], begun: frozenset[Begun], emitted) -> int:
        key = plain, begun, emitted
        if key not in self.number:
            self.number[key] = len(self.tuples)
            self.tuples.append((plain, begun))
            self.rows.append({})
            self.emits.append(emitted)
        return self.number[key]

    def symbol(self, kinds: frozenset[str], places: frozenset[tuple[int, int]]) -> int:
        key = kinds, places
        if key not in self.symbols:
            self.symbols[key] = len(self.known)
            self.known.append(key)
        return self.symbols[key]

    def step(self, state: int, symbol: int) -> int:
        plain, begun = self.tuples[state]
        if symbol < 2:
            return self._stepped(state, symbol, (0,) * len(PARTS),
                                 begun if symbol == LINE_BREAK else _NOTHING, None)
        kinds, places = self.known[symbol]
        plain = tuple(part.step.get((s, kind if kind in kinds else None), part.step[s, None])
                      for s, (kind, part) in zip(plain, PARTS.items(), strict=True))
        says = frozenset(part.says[s] for s, part in zip(plain, PARTS.values(), strict=True)) - {""}
        holds = says - {"insult"}
        begun, ended = threatened(begun, places, holds)
        hurt = case(holds) if "insult" in says else None
        threat = min(map(case, ended), default=None)
        return self._stepped(state, symbol, plain, begun,
                             None if hurt is None and threat is None else (hurt, threat))

    def _stepped(self, state, symbol, plain, begun, emitted) -> int:
        row = self.rows[state]
        row[symbol] = self._state(plain, begun, emitted)
        return row[symbol]


_KIND = ({w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS}
         | {w: "report" for w in REPORTS})
_PLACES: dict[str, set[tuple[int, int]]] = {}
for _threat, _parts in enumerate(THREATS):
    for _at, _words in enumerate(_parts):
        for _word in _words:
            _PLACES.setdefault(_word, set()).add((_threat, _at))


def arcs_of(word: str) -> Iterator[str]:
    """The beginnings of a word, and the whole word, marked by a trailing blank."""
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]
    if len(word) <= 24:
        yield word + " "


class Tokens(dict):
    """Symbol and insult weight of each token, worked out when it is first read."""

    def __init__(self, arcs: dict[str, float], automaton: Composed):
        super().__init__()
        self.whole = {a.rstrip(" "): w for a, w in arcs.items() if a.endswith(" ")}
        self.begun = {a: w for a, w in arcs.items() if not a.endswith(" ")}
        self.sizes = sorted(set(map(len, self.begun)))
        self.automaton = automaton

    def __missing__(self, token: str) -> tuple[int, float]:
        if token[0] == "\n":
            found = (LINE_BREAK if len(token) == 1 else CLAUSE_END), 0.0
        elif not token[0].isalnum():
            found = CLAUSE_END, 0.0
        else:
            word = token.replace("’", "'")
            weight = max([self.whole.get(word, 0.0),
                          *(self.begun.get(word[:n], 0.0) for n in self.sizes if n <= len(word))])
            kinds = {"insult"} if weight > 0 else set()
            if word in _KIND:
                kinds.add(_KIND[word])
            found = self.automaton.symbol(frozenset(kinds),
                                          frozenset(_PLACES.get(word, ()))), weight
        if len(token) <= 64:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[token] = found
        return found


class Grammar:
    """The insult trie with its weights, and the composed automaton."""

    def __init__(self, arcs: dict[str, float]):
        self.automaton = Composed()
        self.tokens = Tokens(arcs, self.automaton)

    def features(self, text: str) -> list[float]:
        if len(self.automaton.tuples) > MOST_STATES:
            self.automaton.clear()
        tokens, rows = self.tokens, self.automaton.rows
        emits, step = self.automaton.emits, self.automaton.step
        sums, clauses, n_words, most, state, matched = [0.0] * 4, 0, 1, 0.0, 0, False
        for token in _TOKEN.finditer(text.lower()):
            symbol, insulting = tokens[token[0]]
            after = rows[state].get(symbol)
            state = step(state, symbol) if after is None else after
            if symbol < 2:
                clauses += matched
                matched = False
                continue
            n_words += 1
            emitted = emits[state]
            if emitted:
                matched = True
                for at, weight in zip(emitted, (insulting, THREAT), strict=True):
                    if at is not None:
                        sums[at] += weight
                        if at in (PLAIN, TARGETED):
                            most = max(most, weight)
        clauses += matched
        asserted = sums[PLAIN] + sums[TARGETED]
        return [1.0, math.log1p(asserted), math.log1p(sums[PLAIN]), math.log1p(sums[TARGETED]),
                math.log1p(sums[NEGATED]), math.log1p(sums[REPORTED]),
                asserted / math.sqrt(n_words), 100 * asserted / (n_words + 20),
                most, math.log1p(clauses), math.log1p(n_words), min(1.0, asserted)]


# Used where nothing is labelled: every feature of matched clauses counts a little.
PRIOR = [-3.0, 1.0, 0.5, 0.5, -0.5, -0.5, 0.5, 0.0, 0.3, 0.2, -0.1, 1.0]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; features are scaled within."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (y - p) - ridge * b
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b / scale


def _ratio(a: float, n: float, b: float, m: float) -> float:
    """Twice the log likelihood ratio of a of n toxic texts against b of m others."""
    def part(k: float, of: float, share: float) -> float:
        return (k * math.log(share) if k else 0.0) + (
            (of - k) * math.log(1 - share) if of > k else 0.0)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


def chosen_arcs(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Beginnings that mark toxic texts, each the best of those it begins or that begin it.

    The weight is the logarithm of how much likelier a toxic text holds it.
    """
    rated = []
    for arc, (a, b) in counts.items():
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        if odds > 1.5 and (ratio := _ratio(a, toxic, b, other)) >= LEAST_RATIO:
            rated.append((-ratio, -len(arc), arc, odds))
    taken: dict[str, float] = {}
    shadowed: set[str] = set()
    for _, _, arc, odds in sorted(rated):
        beginnings = {arc[:n] for n in range(1, len(arc))}
        if arc in shadowed or beginnings & taken.keys():
            continue
        taken[arc] = odds
        shadowed |= beginnings
        if len(taken) >= MOST_ARCS:
            break
    return taken


def _count_arcs(only: frozenset[str] | None):
    """Texts that hold each arc, by label, counted per partition."""
    schema = pa.schema([("arc", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   strict=True):
                found = {arc for word in set(_WORD.findall((text or "").lower().replace("’", "'")))
                         for arc in arcs_of(word)}
                counts[label].update(found if only is None else found & only)
        arcs = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(arcs), 50_000):
            part = arcs[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][a] for a in part], pa.int64()),
                 pa.array([counts[0][a] for a in part], pa.int64())], schema=schema)
    return run


def _measurer(arcs: dict[str, float]):
    schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(arcs)
        for batch in batches:
            features = [grammar.features((t or b"").decode()) for _, _, part in words.parts(batch.column(0))
                        for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array(features, schema[1].type)],
                schema=schema)
    return run


class Model(NamedTuple):
    arcs: dict[str, float]
    weights: list[float]


def hashed(docs: DataFrame) -> DataFrame:
    """Rows with a hash of id and text, by which they are drawn."""
    return docs.withColumn("row_hash", F.xxhash64(F.lit("toxicity"), "doc_id", "text"))


def learned(labelled: DataFrame, rows: int = TRAINING_ROWS, texts: DataFrame | None = None) -> Model:
    """Learn from (doc_id, text, label 0 or 1); about half of ``rows`` rows of each label are drawn.

    ``labelled`` may have ``row_hash`` in place of the text, and ``texts`` (row_hash, text) be given: then
    no text is shuffled, and the drawn hashes, bounded by ``rows``, go round to find theirs.
    """
    prior = {w + " ": 2.0 for w in INSULTS}
    if "row_hash" not in labelled.columns:
        labelled = hashed(labelled)
    known = labelled.filter("label in (0, 1)").withColumn(
        "draw", F.pmod("row_hash", F.lit(1 << 40)))
    counts = {r.label: r for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()}
    if len(counts) < 2:
        return Model(prior, PRIOR)
    limit = F.create_map(*(F.lit(x) for label, r in counts.items() for x in (
        label, max(r.least, int(min(1.0, rows / 2 / r.n) * (1 << 40))))))
    drawn = known.filter(F.col("draw") <= limit[F.col("label")]).withColumn(
        "label", F.col("label").cast("int")).dropDuplicates(["label", "row_hash"])
    if texts is not None:
        drawn = texts.join(F.broadcast(reliable(drawn.select("row_hash", "label"))),
                           "row_hash").dropDuplicates(["label", "row_hash"])
    sample = reliable(drawn.select("text", "label"))
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
             .collect()}
    toxic, other = sizes[1], sizes[0]

    def counted(given: DataFrame, only: frozenset[str] | None) -> DataFrame:
        return (given.mapInArrow(_count_arcs(only), "arc string, toxic long, other long")
                .groupBy("arc").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))

    frequent = counted(sample.filter("label = 1"), None).filter(
        F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic))
    candidates = frozenset(r.arc for r in frequent.select("arc").collect())
    found = {r.arc: (r.toxic, r.other) for r in counted(sample, candidates).collect()}
    arcs = prior | chosen_arcs(found, toxic, other)
    measured = sample.mapInArrow(_measurer(arcs), "label int, features array<double>").collect()
    x = np.array([r.features for r in measured])
    y = np.array([r.label for r in measured], float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums must not depend on it
    weights = fitted(x[order], y[order])
    weights[0] += math.log(counts[1].n / counts[0].n) - math.log(toxic / other)
    return Model(arcs, weights.tolist())


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, weights = Grammar(model.value.arcs), np.array(model.value.weights)
        for batch in batches:
            for begin, end, texts in words.parts(batch.column(1)):
                x = np.array([grammar.features((t or b"").decode()) for t in texts])
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(score)],
                    names=["doc_id", "score"])
    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return given.mapInArrow(_scorer(sent), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document, learned from the folds not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(
        held_out(F.col("doc_id"), FOLDS) != HELD_OUT)
    texts = hashed(docs)
    model = learned(texts.drop("text").join(labels.withColumnRenamed("toxic", "label"), "doc_id"),
                    texts=texts.select("row_hash", "text"))
    return scored(docs, model).select(
        "doc_id", (held_out(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"))
