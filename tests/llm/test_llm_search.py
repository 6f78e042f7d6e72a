"""Suffix-array dedup, ranked search and conversation repair against brute force."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import EDGE, SCHEMA, ordered
from pyspark.sql import functions as F

from lanewise.llm import conversations, ranked, suffixes
from lanewise.llm.common import table


def frame(spark, rows, schema=SCHEMA):
    """Rows beside columns whose names clash with those of the operators."""
    clashing = ("key_a", "token", "n", "span", "marks", "terms", "fault", "copy", "part")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in clashing})


def test_multikey_quicksort():
    draw = np.random.default_rng(3)
    for n, width, values in ((0, 3, 2), (1, 2, 2), (500, 4, 2), (2000, 3, 50), (300, 5, 1)):
        keys = draw.integers(0, values, (n, width)).astype(np.uint64)
        for parts in (1, 7):
            size = np.diff(np.linspace(0, n, parts + 1).astype(int))
            order, same = suffixes.multikey_quicksort(keys, np.arange(n), size)
            begin = 0
            for part in size.tolist():
                rows = [keys[i].tolist() for i in order[begin:begin + part]]
                assert sorted(order[begin:begin + part]) == list(range(begin, begin + part))
                assert rows == sorted(rows)
                assert same[begin:begin + part].tolist() == [
                    k > 0 and rows[k] == rows[k - 1] for k in range(part)]
                begin += part


def repeats():
    """Passages that many texts share, with other text around and single letters changed."""
    draw = random.Random(11)

    def prose(n):
        return " ".join(draw.choice("lorem ipsum dolor sit amet über ça 漢字 x yz".split()) + str(
            draw.randint(0, 300)) for _ in range(n))

    shared = [prose(n) for n in (6, 12, 40, 300)]
    rows = [(i, prose(draw.randint(0, 8)) + draw.choice(shared) + prose(draw.randint(0, 8)))
            for i in range(120)]
    rows += [(1000 + i, shared[2][:i] + "#" + shared[2][i:]) for i in range(0, 200, 7)]
    rows += [(2000, "ab" * 400), (2001, "a" * 500), (2002, "a" * 61), (2003, "漢" * 40), (2003, "漢" * 40)]
    return rows


@pytest.mark.parametrize("length, seed, piece, together", [
    (60, 16, suffixes.PIECE, suffixes.SORTED), (61, 32, 97, 5), (200, 32, 1000, 100)])
def test_suffix_array_dedup(spark, length, seed, piece, together):
    rows = repeats() + EDGE
    found = suffixes.without_repeats(frame(spark, rows).repartition(7), length, seed, piece, together)
    got = found.select("doc_id", "n_bytes", F.expr(
        "aggregate(removed, 0L, (n, r) -> n + r.last - r.first + 1)"), F.size("removed"),
        F.col("kept")).collect()
    assert ordered((*r[:4], bytes(r[4])) for r in got) == ordered(
        brute.without_repeated_bytes(rows, length))


@pytest.fixture
def many_buckets(spark):
    """Small tables are cut as large ones are: buckets are not joined again."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("length, seed, together, frequent", [
    (60, 16, 50, 0), (61, 32, suffixes.SORTED, 3), (200, 32, 100, 1)])
def test_suffix_array_dedup_of_cut_tokens(spark, many_buckets, length, seed, together, frequent):
    rows = repeats() + EDGE
    found = suffixes.without_repeats(frame(spark, rows), length, seed, 1000, together, frequent)
    got = found.select("doc_id", "n_bytes", F.expr(
        "aggregate(removed, 0L, (n, r) -> n + r.last - r.first + 1)"), F.size("removed"),
        F.col("kept")).collect()
    assert ordered((*r[:4], bytes(r[4])) for r in got) == ordered(
        brute.without_repeated_bytes(rows, length))


def test_suffix_array_rows_of_a_frequent_passage(spark, many_buckets, monkeypatch):
    """Windows across the ends of a passage that many texts hold do not leave their buckets one by one."""
    draw, made, sorter = random.Random(5), spark.sparkContext.accumulator(0), suffixes._bucket_sorter

    def letters(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    def counting(*given):
        def run(batches):
            for batch in sorter(*given)(batches):
                made.add(batch.num_rows)
                yield batch
        return run

    monkeypatch.setattr(suffixes, "_bucket_sorter", counting)
    passage = letters(300)
    rows = [(i, letters(200) + passage + letters(200)) for i in range(1500)]
    found = suffixes.without_repeats(frame(spark, rows))
    got = found.select("doc_id", "n_bytes", F.expr(
        "aggregate(removed, 0L, (n, r) -> n + r.last - r.first + 1)"), F.size("removed"),
        F.col("kept")).collect()
    assert ordered((*r[:4], bytes(r[4])) for r in got) == ordered(
        brute.without_repeated_bytes(rows, 200))
    # Each text has a few places near either end of the passage, with up to 169 windows each.
    assert made.value <= 20 * len(rows)


def test_suffix_array_dedup_of_nothing(spark):
    assert suffixes.without_repeats(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffixes.without_repeats(frame(spark, []), length=400)


def test_suffix_array_query(spark, sf_small):
    docs = table(spark, sf_small, "documents", "doc_id", "text").collect()
    got = suffixes.op11_suffix_array_dedup(spark, sf_small).collect()
    want = brute.without_repeated_bytes(map(tuple, docs), 200)
    assert ordered(map(tuple, got)) == ordered(
        (*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want)


def test_ranked_search(spark, monkeypatch):
    draw = random.Random(4)
    rows = EDGE + [(100 + i, " ".join(f"t{draw.randint(0, 60)}" for _ in range(draw.randint(1, 90))))
                   for i in range(400)] + [(7, "t1 t2 t3"), (7, "t1 t2 t3"), (None, "t1 t2 t3")]
    items = [(1, "t1 T2 t2, t3."), (1, "t1 T2 t2, t3."), (None, "t5 t6"), (3, None), (4, ""), (5, "--"),
             (6, "unknown words"), (8, " ".join(f"t{k}" for k in range(60))), (9, "漢字 same 12 é")]
    given = frame(spark, items, "item_id long, text string")
    docs = frame(spark, rows).repartition(5)
    monkeypatch.setattr(ranked, "FIRST", 40)  # so that a first round sets lowest scores
    for top, block in ((20, 1 << 18), (3, 8)):
        got = ranked.best_documents(docs, given, top, block)
        assert ordered(got.collect()) == ordered(brute.best_documents(rows, items, top))


def test_bucket_bounds():
    """Small buckets in one process: what is pruned does not change the best."""
    draw = np.random.default_rng(1)
    n = 3000
    size = draw.integers(1, 30, n)
    terms = [np.unique(draw.integers(0, 200, s)) for s in size]
    counts = [draw.integers(1, 5, len(t)) for t in terms]
    length = np.array([c.sum() + 3 for c in counts])
    items = ranked.Items(list(range(20)), [draw.integers(0, 200, 9) for _ in range(20)],
                         draw.integers(0, 9000, 200))
    block = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(length), pa.array([t.tolist() for t in terms], pa.list_(pa.int32())),
         pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))], schema=ranked._VECTOR)
    kept = ranked.Kept([0] * 20, 10)
    for begin in range(0, n, 700):
        ranked._search(block.slice(begin, 700), items, n, int(length.sum()), kept)
    m = 75 + 25 * length * n // length.sum()
    for i in range(20):
        value = dict(zip(items.terms[i].tolist(), items.values[i].tolist(), strict=True))
        scores = [sum(value.get(t, 0) * (10**9 * c // (1000 * c + 12 * int(m[d])))
                      for t, c in zip(terms[d].tolist(), counts[d].tolist(), strict=True))
                  for d in range(n)]
        best = sorted((-s, d) for d, s in enumerate(scores) if s > 0)[:10]
        assert [(-s, d) for s, d in zip(kept.scores[i].tolist(), kept.ids[i].tolist(), strict=True)] \
            == best


def test_ranked_search_of_nothing(spark):
    docs, none = frame(spark, EDGE), frame(spark, [], "item_id long, text string")
    assert ranked.best_documents(docs, none).collect() == []
    items = frame(spark, [(1, "same words")], "item_id long, text string")
    assert ranked.best_documents(frame(spark, []), items).collect() == []


CONVERSATIONS = "conv_id long, turn long, role string, text string"
COUNTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
          "repaired_sha256"]


def talks():
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(1, 13)]), draw.choice([None, *range(1, 10), 10**6]),
             draw.choice([None, "", "user", "assistant", "system", "User", "agent", "tool", "a", "s"]),
             draw.choice([None, "", " ", "Hi.", "Yes!", "no", "a ", "x.\n ", "Ok? é", "q\x0b"]))
            for _ in range(150)]
    rows += [(draw.randint(100, 160), draw.randint(0, 9), draw.choice(["user", "assistant", "system"]),
              draw.choice(["Hi.", "Yes!", "no", "ok", "more."]) + str(draw.randint(0, 3)) * draw.randint(0, 1))
             for _ in range(600)]
    return rows + [(500, k, "user" if k % 3 else "assistant", f"Turn {k}.") for k in range(3000)] + [
        (501, 1, "user", "long " * 100_000 + "."), (501, 2, "assistant", "fine.")]


@pytest.mark.parametrize("held", [1, 3, conversations.HELD])
def test_conversation_repair(spark, held):
    rows = talks()
    given = conversations.damaged(frame(spark, rows, CONVERSATIONS).repartition(6))
    want = brute.repaired(rows)
    got = conversations.repaired(given, held).select(COUNTS)
    assert ordered(got.collect()) == ordered(w[:-1] for w in want)
    turns = conversations.repaired_turns(given, held).collect()
    assert ordered((t.conv_id, t.place, t.role, t.text) for t in turns) == ordered(
        (w[0], k, *turn) for w in want for k, turn in enumerate(w[-1]))


def test_conversation_query(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").collect()
    got = conversations.op13_conversation_repair(spark, sf).select(COUNTS)
    assert ordered(got.collect()) == ordered(w[:-1] for w in brute.repaired(map(tuple, rows)))


def test_no_conversations(spark):
    none = frame(spark, [], CONVERSATIONS)
    assert conversations.repaired(conversations.damaged(none)).collect() == []
    dropped = [(c, 1, "user", "Hi.") for c in range(200)]
    got = conversations.repaired(conversations.damaged(frame(spark, dropped, CONVERSATIONS)))
    assert got.count() == 200 and got.filter("n_turns = 0 and audit = '' and cost = 0").count() > 0
