"""Licence scans over a positional index of rare tokens, in DataFrame functions only.

The templates are short word sequences with mandatory key phrases.  One pass counts in how many
documents each licence word occurs; the mandatory word with the highest inverse document frequency (IDF)
of a template becomes its anchor: every place that counts holds it, so none is missed.  A second pass looks
each file's anchors up.  A file with an anchor gets the postings of all mandatory words; a posting at word p
proposes a start of p minus the word's place in the template, and the proposals of a template's mandatory
words, the anchor's first, are intersected: what is left are the starts at which all key phrases stand.  Such
a place counts if the words found there, optional ones included, weigh (by IDF) ``SHARE`` of the template
or more; optional words are looked up at their place, which takes one step whatever the file holds.  The
base phrases are templates that are mandatory throughout, so they are found exactly.

The words of a file stay in its row: nothing is shuffled but the counts, one per licence word and
task.  Only those counts (as many as the templates have words) reach the driver.

Defined cases: null, empty and wordless texts have no words, labels and places and a score of 0;
repeated rows are scanned like any other; an empty table gives an empty result; overlapping places
all count; other columns are not touched.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import LOWER, UPPER, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.7


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]  # places in ``words``
    base: bool


def template(label: str, text: str, *phrases: str) -> Template:
    """A licence sentence whose ``phrases`` are mandatory; without phrases, all of it is."""
    words = tuple(text.split())
    places: set[int] = set()
    for phrase in phrases:
        wanted = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i:i + len(wanted)] == wanted)
        places |= set(range(at, at + len(wanted)))
    return Template(label, words, tuple(sorted(places or range(len(words)))), not phrases)


TEMPLATES = (
    # fixed values: the phrases and labels of the contract
    template("gpl", "gnu general public license"),
    template("apache", "apache license"),
    template("cc-by", "cc by"),
    template("mit", "mit license"),
    # labels of this method: sentences of common licence notices
    template("all-rights-reserved", "all rights reserved", "rights reserved"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license",
             "2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without "
             "modification are permitted", "redistribution and use", "binary forms"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "creative commons attribution sharealike", "attribution sharealike"),
    template("gpl-3.0", "licensed under the gnu general public license version 3",
             "gnu general public license", "3"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a "
             "copy of this software", "hereby granted free of charge"),
    template("mit-notice", "released under the mit license", "mit license"),
    template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain",
             "unencumbered software"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER),
                                F.lit(WORDS), F.lit(0))


def word_weights(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """The IDF of every template word, over all rows of ``docs`` (text)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.array_distinct(F.filter(
        words_of(F.col("text")), lambda w: w.isin(vocabulary))).alias("w"))
    # The outer form: before the plain one Spark puts a filter that would take every text apart twice.
    counts = {r.w: r.n for r in found.select(F.explode_outer("w").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def anchor(t: Template, weights: dict[str, float]) -> int:
    """The place of the mandatory word with the highest IDF."""
    return min(t.mandatory, key=lambda i: (-weights[t.words[i]], i))


def _postings(words: Column, wanted: list[str]) -> Column:
    """Every place of the wanted words, as (word, at)."""
    places = F.transform(words, lambda w, i: F.when(
        w.isin(wanted), F.struct(w.alias("word"), i.alias("at"))))
    return F.filter(places, lambda p: p.isNotNull())


def _places(t: Template, weights: dict[str, float]) -> Column:
    """Where the template stands in a row's ``words``, from its ``anchors`` and ``postings``."""
    first, n = anchor(t, weights), len(t.words)
    total = sum(weights[w] for w in t.words)

    def starts(postings: str, i: int) -> Column:
        mine = F.filter(postings, lambda p: p["word"] == t.words[i])
        return F.transform(mine, lambda p: p["at"] - i)

    def is_there(start: Column, i: int) -> Column:
        return F.get("words", start + i) == t.words[i]

    others = sorted((i for i in t.mandatory if i != first), key=lambda i: (-weights[t.words[i]], i))
    met = reduce(F.array_intersect, (starts("postings", i) for i in others), starts("anchors", first))
    verified = F.filter(met, lambda s: (s >= 0) & (s + n <= F.size("words")))
    found = F.transform(verified, lambda s: F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"),
        (sum((F.when(is_there(s, i), weights[t.words[i]]).otherwise(0.0) for i in range(n)),
             F.lit(0.0)) / total).alias("share")))
    return F.filter(found, lambda p: p["share"] >= SHARE)


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, and ``places``, an array of
    (label, base, start, share) of all templates found."""
    weights = word_weights(docs.select("text"), templates)
    wanted = sorted({t.words[anchor(t, weights)] for t in templates})
    mandatory = sorted({t.words[i] for t in templates for i in t.mandatory})
    indexed = docs.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", "words", _postings(F.col("words"), wanted).alias("anchors")).select(
        "doc_id", "words", "anchors",
        F.when(F.size("anchors") > 0, _postings(F.col("words"), mandatory)).alias("postings"))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    places = F.concat(*(_places(t, weights) for t in templates))
    return indexed.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("anchors") > 0, places).otherwise(empty).alias("places"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence phrases and labels."""
    found = scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.col("places.label")).alias("labels"),
        F.round(F.coalesce(F.array_max("places.share"), F.lit(0.0)), 6).alias("score"))


def _oracle() -> str:
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {str(i in t.mandatory).lower()})"
        for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    return rf"""
    WITH template(t, label, base, i, w, mandatory) AS (VALUES {rows}),
    split AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words
        FROM documents),
    word AS (
        SELECT r, u.w, u.pos FROM (
            SELECT r, unnest(list_zip(words, range(len(words)))) AS z FROM split),
            LATERAL (SELECT z[1] AS w, z[2] AS pos) u
        WHERE u.w IN (SELECT w FROM template)),
    weight AS (
        SELECT v.w, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT r) + 1)) + 1 AS idf
        FROM (SELECT DISTINCT w FROM template) v LEFT JOIN word ON word.w = v.w GROUP BY v.w),
    weighed AS (
        SELECT *, row_number() OVER (PARTITION BY t, mandatory ORDER BY idf DESC, i) AS n
        FROM template JOIN weight USING (w)),
    size AS (
        SELECT t, label, base, count(*) AS n_words, sum(idf) AS total,
               count(*) FILTER (WHERE mandatory) AS n_mandatory
        FROM weighed GROUP BY t, label, base),
    proposed AS (
        SELECT r, t, pos - i AS start FROM weighed JOIN word USING (w) WHERE mandatory AND n = 1),
    place AS (
        SELECT p.r, size.label, size.base, p.start, sum(idf) / any_value(total) AS share
        FROM proposed p JOIN size USING (t) JOIN split USING (r) JOIN weighed x USING (t)
        JOIN word ON word.r = p.r AND word.pos = p.start + x.i AND word.w = x.w
        WHERE p.start >= 0 AND p.start + n_words <= len(words)
        GROUP BY p.r, p.t, size.label, size.base, p.start
        HAVING count(*) FILTER (WHERE mandatory) = any_value(n_mandatory)
           AND sum(idf) / any_value(total) >= {SHARE})
    SELECT any_value(doc_id) AS doc_id, any_value(len(words)) AS n_words,
           count(*) FILTER (WHERE base) AS n_base,
           min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '')
               AS base_labels,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
           round(coalesce(max(share), 0), 6) AS score
    FROM split LEFT JOIN place USING (r) GROUP BY r"""


ORACLE = {"op3_license_scan": _oracle()}
