"""Exact, near, substring and line dedup against plain Python on hard rows."""

import random

import numpy as np
import pytest
from brute import (
    EDGE, LONG, SCHEMA, exact_groups, near_groups, ordered, without_repeated_lines, without_repeats,
)
from pyspark.sql import functions as F

from lanewise.llm import exact, graph, lines, near, passages, words


@pytest.fixture(scope="module")
def edge(spark):
    """Hard rows, with further columns that clash with names used inside."""
    return spark.createDataFrame(EDGE, SCHEMA).select(
        "*", F.lit(1).alias("node"), F.lit("x").alias("row_key"), F.lit(2).alias("kept"),
        F.lit(3).alias("anchor"), F.lit(None).cast("int").alias("lines"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def copies(seed: int, n: int) -> list[tuple]:
    """Texts with copies of every degree: equal, edited, cut and joined."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "eo", "ist", "und", "ör")]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, len(w) // 12, len(w) // 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w += rng.choice(texts).split(" ")[:rng.randrange(80)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20, 60, 150]))]
        text = " ".join(w)
        texts.append(text)
        rows.append((i, text.replace(" ", rng.choice([" ", "\n", "  "]), 1)))
    return rows


def test_exact_dedup(spark, edge):
    found = exact.exact_dedup(edge)
    assert ordered(found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()) == \
        ordered(exact_groups(EDGE))
    assert set(found.columns) >= set(edge.columns)


def test_exact_dedup_spills_to_the_same_result(spark):
    rows = copies(1, 200)
    found = exact.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), spill_bytes=2000)
    assert ordered(found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()) == \
        ordered(exact_groups(rows))


def test_trie_keeps_the_better_owner():
    trie = exact.Patricia()
    for key, owner in ((b"abcd", (-4, 9, 1)), (b"abxy", (-4, 2, 1)), (b"ab", (-2, 3, 1)),
                       (b"", (0, 5, 1)), (b"abcd", (-4, 7, 1)), (b"abcd", (-6, 8, 1))):
        trie.insert(key, owner)
    assert dict(trie.terminals()) == {b"abcd": (-6, 8, 3), b"abxy": (-4, 2, 1), b"ab": (-2, 3, 1),
                                      b"": (0, 5, 1)}


def test_one_row_of_each_text_stays(spark, edge):
    left = exact.distinct_rows(edge).select("doc_id", "text").collect()
    assert len(left) == len({r[3] for r in exact_groups(EDGE)})
    assert exact.distinct_rows(edge).columns == edge.columns


def test_near_dedup_on_hard_rows(spark, edge):
    found = near.near_dedup(edge, size=2)
    assert ordered(found.select("doc_id", "n_shingles", "component_id").collect()) == \
        ordered(near_groups(EDGE, 2, 80))


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_on_copies(spark, size):
    rows = copies(2, 260)
    found = near.near_dedup(spark.createDataFrame(rows, SCHEMA), size=size)
    assert ordered(found.select("doc_id", "n_shingles", "component_id").collect()) == \
        ordered(near_groups(rows, size, 80))


def test_near_dedup_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(40)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    found = near.near_dedup(spark.createDataFrame(rows, SCHEMA), size=2)
    assert ordered(found.select("doc_id", "n_shingles", "component_id").collect()) == \
        ordered(near_groups(rows, 2, 80))


def test_one_of_each_keeps_columns(spark, edge):
    left = near.one_of_each(edge, size=2)
    assert left.columns == edge.columns
    assert {r.doc_id for r in left.collect()} >= {1, 2, 3, 4, 5, 7, 9}
    assert 6 not in {r.doc_id for r in left.collect()}


def test_sketches_lose_far_less_than_bands():
    bands = (1 - 0.8 ** near.ROWS) ** near.BANDS
    assert near.odd_bits_beyond(0.8)[near.most_odd_bits(80)] < bands / 100
    rng = np.random.default_rng(5)
    same = rng.integers(0, 1 << 32, (near.SAMPLES, 2000))
    other = np.where(rng.random(same.shape) < 0.2, rng.integers(0, 1 << 32, same.shape), same)
    odd = np.bitwise_count(near.odd_sketches(same) ^ near.odd_sketches(other)).sum(axis=1)
    for k in (70, 80, 90):
        assert abs((odd > k).mean() - near.odd_bits_beyond(0.8)[k]) < 0.05


def test_odd_sketches_estimate_high_similarities():
    rng = random.Random(3)
    for j in (0.8, 0.9, 0.95):
        n = 2000
        shared = [rng.getrandbits(64) for _ in range(int(2 * n * j / (1 + j)))]
        estimates = []
        for _ in range(10):
            texts = [" ".join(map(str, shared + [rng.getrandbits(64) for _ in range(n - len(shared))]))
                     .encode() for _ in range(2)]
            _, _, _, sketch = near.sign(texts, 1)
            odd = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
            estimates.append(float(near.similarity(odd)))
            assert odd <= near.most_odd_bits(80)
        assert abs(sum(estimates) / 10 - j) < 0.03


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200))
                                                  for _ in range(60)] + [(7, 7)]
    group = {x: x for e in edges for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        group[b] = a
    found = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in linked}


@pytest.mark.parametrize("length", [6, 10, 35])
def test_substring_dedup(spark, edge, length):
    for rows in (EDGE, copies(6, 150), [(1, "a b " * 100), (2, LONG), (3, LONG[:5000])]):
        found = passages.without_repeats(spark.createDataFrame(rows, SCHEMA), length)
        gone = found.select("doc_id", "n_words", F.expr(
            "aggregate(removed, 0L, (n, r) -> n + r.last - r.first + 1)").alias("gone"), "kept_text")
        assert ordered(gone.collect()) == ordered(without_repeats(rows, length))
    assert passages.without_repeats(edge, length).count() == len(EDGE)


def test_line_dedup(spark, edge):
    rng = random.Random(8)
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, "a\nb\nc"),
            (5, "r\nr\nr\nr\nr"), (6, "q\nr\nr\nr"), (7, "é\n\n\n\n"), (8, "z\n\n\n\n")]
    rows += [(i, "\n".join(rng.choice("pqst") for _ in range(rng.randrange(9))))
             for i in range(9, 60)]
    found = lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert ordered(found.collect()) == ordered(without_repeated_lines(rows))
    hard = {r.doc_id: r for r in lines.without_repeated_lines(edge).collect() if r.doc_id}
    assert hard[1].kept_text == "" and hard[7].kept_text == LONG and hard[11].n_lines == 5
    assert lines.without_repeated_lines(edge).count() == len(EDGE)


def test_empty_tables(none):
    assert exact.exact_dedup(none).count() == 0
    assert near.near_dedup(none).count() == 0
    assert passages.without_repeats(none).count() == 0
    assert lines.without_repeated_lines(none).count() == 0


def test_word_hashes_do_not_depend_on_neighbours():
    a = words.split([b"one two", b"three"], lower=True)
    b = words.split([b"THREE", b"x one  two"], lower=True)
    assert a.hashes[2] == b.hashes[0] and list(a.hashes[:2]) == list(b.hashes[2:])
    assert len({int(h) for h in a.hashes}) == 3
    assert list(a.first) == [0, 2, 3]


def test_long_texts_cross_segments(monkeypatch):
    whole = words.split([LONG.encode()]).hashes
    monkeypatch.setattr(words, "SEGMENT", 1000)
    assert list(words.split([LONG.encode()]).hashes) == list(whole)
