"""Conversation structure repair: a cheapest sequence of edits, found while the turns stream by.

Conversations are dealt out whole and sorted by turn; a task walks through its Arrow batches and carries
one dynamic program from batch to batch.  The program's states are what the repaired conversation ends
with so far: nothing, ``s``, ``u`` or ``a``.  For each state it holds the least cost, the edits' rank among
the states (so that the ASCII-least audit wins ties) and a running digest of the repaired text: constant
memory however long a conversation is.  What grows is one byte per state and turn, the back pointer;
beyond ``HELD`` turns it goes to an unnamed scratch file of the task, read from the back to write down the
audit.  A lost task starts over from the shuffle.  Where the
repaired turns themselves are wanted (``repaired_turns``), a conversation's turns are spooled the same way
and read once more, in order, when the audit is known.

Edits of a turn: K keeps it (0), R gives it the role user or assistant (3), D deletes it (4); I inserts an
empty turn of user or assistant before it or at the end (3).  A kept or rewritten truncated turn costs 3
more.  Blank and repeated turns must go.  What stays must read ``(s?(ua)+)?`` in roles' initials.

Ranks decide ties exactly: with the inserts before a turn and its own edit as one word, no word is a
prefix of another, so of two audits over equally many turns the smaller one stays smaller whatever
follows.  An insert before a deletion never wins, since D < I: deleting first costs the same.

Repeated turns (role and text seen earlier in the conversation) are found by a window over (conversation,
role, text digest of 128 bits) on the same partitioning, which spills, so that no task holds the texts it
has seen.

Defined cases: a null role or text counts as one blank; a null turn comes first and is no number; a null
conversation id is one conversation; turns with equal number follow each other by role, then text; repeated
rows are repeated turns; a conversation without any turn left has an empty audit; an empty table gives an
empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import itertools
import marshal
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import SPACE, table

HELD = 1 << 20
SPOOLED = 1 << 24
KEEP, REWRITE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL_PAIRS = ("su", "ua", "au")
NOT_SPACE = r"[^\x20\x09-\x0D]"

# Words of a turn's edits; in the order of a back pointer's code, which is that of ASCII.
WORDS = ("D", "IK", "IR", "K", "R")
_NONE = 255


def kept_state(state: int, initial: str) -> int | None:
    """Where keeping a turn with this initial leads, if it may stand there."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return None


def _moves() -> dict[str, list[list[tuple[int, int, int, tuple[str, ...]]]]]:
    """For a turn's initial and each state reached: (state before, word, cost, roles added).

    An empty role in the last field stands for the turn's own.
    """
    found = {}
    for initial in ("s", "u", "a", ""):
        into: list[list] = [[] for _ in range(4)]
        for before in range(4):
            into[before].append((before, 0, DELETE, ()))
            for inserted in (False, True):
                state, added = (NEXT[before], (ROLES[NEXT[before]],)) if inserted else (before, ())
                cost = INSERT * inserted
                kept = kept_state(state, initial)
                if kept is not None:
                    into[kept].append((before, 1 if inserted else 3, cost + KEEP, (*added, "")))
                after = NEXT[state]
                into[after].append((before, 2 if inserted else 4, cost + REWRITE,
                                    (*added, ROLES[after])))
        found[initial] = into
    return found


MOVES = _moves()
# Inserts that make a state a legal end.
ENDING = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}


class Pointers:
    """Back pointers of four states, a byte each; beyond ``held`` turns in an unnamed scratch file."""

    def __init__(self, held: int = HELD):
        self.held, self.recent, self.file = 4 * held, bytearray(), None

    def add(self, pointers: bytes) -> None:
        self.recent += pointers
        if len(self.recent) >= self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.recent)
            self.recent = bytearray()

    def backwards(self) -> Iterator[bytes]:
        """Blocks of whole turns, the last one first."""
        yield bytes(self.recent)
        if self.file:
            end = self.file.tell()
            while end:
                end -= self.held
                self.file.seek(end)
                yield self.file.read(self.held)
            self.file.close()


class Repair:
    """The dynamic program of one conversation, fed turn by turn."""

    def __init__(self, held: int = HELD):
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.text = [hashlib.sha256(), None, None, None]
        self.begun = [False] * 4
        self.pointers = Pointers(held)

    def feed(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        best: list = [None] * 4
        for state, moves in enumerate(MOVES[initial]):
            for before, word, cost, roles in moves:
                if self.cost[before] is None or (must_go and word):
                    continue
                more = TRUNCATED if truncated and word else 0
                found = (self.cost[before] + cost + more, self.rank[before], word, before, roles)
                if best[state] is None or found[:3] < best[state][:3]:
                    best[state] = found
        order = sorted({b[1:3] for b in best if b})
        texts, begun, pointers = [None] * 4, [False] * 4, bytearray([_NONE] * 4)
        for state, found in enumerate(best):
            if found:
                _, _, word, before, roles = found
                texts[state], begun[state] = self._written(before, word, roles, role, text)
                pointers[state] = word << 2 | before
        self.cost = [b and b[0] for b in best]
        self.rank = [order.index(b[1:3]) if b else 0 for b in best]
        self.text, self.begun = texts, begun
        self.pointers.add(pointers)

    def _written(self, before: int, word: int, roles: tuple[str, ...], role: str, text: str):
        """The digest after a word; a rewritten turn keeps its text, an inserted one has none."""
        if word == 0:
            return self.text[before], self.begun[before]
        digest, begun = self.text[before].copy(), self.begun[before]
        for place, added in enumerate(roles):
            last = place == len(roles) - 1
            line = f"{added or role}:{text if last else ''}"
            digest.update((("\n" if begun else "") + line).encode())
            begun = True
        return digest, begun

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        _, _, inserts, state = min(
            (self.cost[s] + INSERT * n, self.rank[s], n, s)
            for s, n in ENDING.items() if self.cost[s] is not None)
        cost = self.cost[state] + INSERT * inserts
        digest, begun, at = self.text[state].copy(), self.begun[state], state
        for _ in range(inserts):
            at = NEXT[at]
            digest.update((("\n" if begun else "") + f"{ROLES[at]}:").encode())
            begun = True
        pieces = ["I" * inserts]
        for block in self.pointers.backwards():
            words = []
            for turn in range(len(block) - 4, -1, -4):
                pointer = block[turn + state]
                words.append(WORDS[pointer >> 2])
                state = pointer & 3
            pieces.append("".join(reversed(words)))
        return cost, "".join(reversed(pieces)), digest.hexdigest()


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()),
                      ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                      ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                      ("repaired_sha256", pa.string())])
SUMMARY = ("conv_id long, n_turns long, blank long, duplicate long, truncated long, illegal long, "
           "gaps long, cost long, audit string, repaired_sha256 string")


_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                    ("role", pa.string()), ("text", pa.string())])


class Spool:
    """Roles and texts of a conversation, in order; beyond ``SPOOLED`` bytes in a scratch file."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(SPOOLED)

    def add(self, role: str, text: str) -> None:
        marshal.dump((role, text), self.file)

    def read(self) -> Iterator[tuple[str, str]]:
        end = self.file.tell()
        self.file.seek(0)
        while self.file.tell() < end:
            yield marshal.load(self.file)
        self.file.close()


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation's turns."""
    state = NOTHING
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        state = kept_state(state, role[:1]) if edit == "K" else NEXT[state]
        yield edit, role if edit == "K" else ROLES[state], text


class _Walk:
    """Counts of one conversation beside its repair, and its turns if they are wanted."""

    def __init__(self, conv_id: int | None, held: int, spooled: bool = False):
        self.conv_id, self.repair = conv_id, Repair(held)
        self.spool = Spool() if spooled else None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.numbers, self.before = 0, None

    def feed(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.turns += 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL_PAIRS
        self.before = role[:1]
        if turn is not None:
            self.numbers += turn != self.most  # sorted: the last number is the largest
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.repair.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        if self.spool:
            self.spool.add(role, text)

    def turns_of(self) -> Iterator[tuple]:
        _, audit, _ = self.repair.end()
        for place, turn in enumerate(edited(audit, self.spool.read())):
            yield self.conv_id, place, *turn

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return (self.conv_id, self.turns, self.blank, self.duplicate, self.truncated, self.illegal,
                gaps, *self.repair.end())


def _walks(batches: Iterator[pa.RecordBatch], held: int, spooled: bool) -> Iterator[_Walk]:
    """The conversations of a partition, each when its last turn has passed."""
    walk = None
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            for conv_id, turn, role, text, fault in zip(
                    *(c.to_pylist() for c in part.columns), strict=True):
                if walk is None or conv_id != walk.conv_id:
                    if walk:
                        yield walk
                    walk = _Walk(conv_id, held, spooled)
                if fault != "gone":
                    walk.feed(turn, role, text, fault)
    if walk:
        yield walk


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)],
            schema=schema)


def _summaries(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches((w.row() for w in _walks(batches, held, False)), _SUMMARY)
    return run


def _turns(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(
            (row for w in _walks(batches, held, True) for row in w.turns_of()), _TURNS)
    return run


def with_faults(turns: DataFrame) -> DataFrame:
    """``fault`` of every row: gone (not there, ``present`` is false), blank, duplicate, truncated."""
    last = F.regexp_extract("text", rf"({NOT_SPACE}){SPACE}*\z", 1)
    seen = F.row_number().over(
        Window.partitionBy("conv_id", "present", "role", "text_digest")
        .orderBy(F.col("turn").asc_nulls_first()))
    return (
        turns.withColumn("text_digest", F.md5(F.col("text").cast("binary")))
        .withColumn("copy", seen)
        .withColumn("fault", F.when(~F.col("present"), "gone")
                    .when(~F.col("text").rlike(NOT_SPACE), "blank")
                    .when(F.col("copy") > 1, "duplicate")
                    .when(~last.isin(".", "!", "?"), "truncated"))
    )


def _by_conversation(turns: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, turn by turn, with their faults."""
    present: Column = F.col("present") if "present" in turns.columns else F.lit(True)
    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        present.alias("present"))
    return (
        with_faults(given.repartition("conv_id"))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
        .select("conv_id", "turn", "role", "text", "fault"))


def repaired(turns: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text and, if there, ``present``):
    counts of faults, cost and edits of the cheapest repair, and the repaired text's digest."""
    return _by_conversation(turns).mapInArrow(_summaries(held), SUMMARY)


def repaired_turns(turns: DataFrame, held: int = HELD) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _by_conversation(turns).mapInArrow(
        _turns(held), "conv_id long, place long, edit string, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of (conv_id, turn): of twenty parts one is dropped
    (``present`` is false), one emptied, one loses its full stops, one is repeated, one becomes user's."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    part = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")),
                  F.lit(20))
    role, text = shown("role"), shown("text")
    return (
        turns.withColumn("part", part)
        .withColumn("times", F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1)))
                                       .otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn",
                F.when(F.col("part") == 4, "user").otherwise(role).alias("role"),
                F.when(F.col("part") == 1, "")
                .when(F.col("part") == 2, F.regexp_replace(text, "[.!?]", ""))
                .otherwise(text).alias("text"),
                (F.col("part") != 0).alias("present"))
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repaired(damaged(turns)).drop("n_turns")


# A shortest path with ties by its letters is beyond SQL; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
