"""Language ID, licences, decontamination, toxicity, pages, BPE and the pipeline."""

import math
import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import EDGE, LOWER, SCHEMA, TOKEN, contained, ordered, sha
from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm import bpe, contamination, language, licenses, pages, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PROSE = {
    "en": "the cat sat on the mat and then the dog went into the garden with some of the others ",
    "de": "der hund lief durch den garten und dann kam die katze auch noch zu den anderen tieren ",
    "fr": "le chat est dans le jardin et puis le chien vient avec les autres pour jouer ensemble ",
}


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).select(
        "*", F.lit(1).alias("score"), F.lit("x").alias("n_tokens"), F.lit(2).alias("words"),
        F.lit("q").alias("lang_pred"), F.lit(None).cast("string").alias("label"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Language ID

def brute_phrases(text: str, sample: str) -> int:
    """Longest matches, block by block, by trying; an unknown letter opens a phrase."""
    n = 0
    for begin in range(0, len(text), language.BLOCK):
        phrase, n = "", n + 1
        for letter in text[begin:begin + language.BLOCK]:
            if phrase + letter in sample:
                phrase += letter
            else:
                phrase, n = letter if letter in sample else "", n + 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    samples = {k: [language.letters(v)] for k, v in PROSE.items()}
    built = language.Languages(samples)
    texts = ["".join(rng.choice("aehinrstd ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts += [language.letters(v * 40) for v in PROSE.values()]
    found = built.phrases(texts)
    for row, text in zip(found, texts, strict=True):
        for k, name in enumerate(built.names):
            assert row[k] == brute_phrases(text, samples[name][0]), (text, name)


def test_every_letter_of_the_samples_counts():
    rng = random.Random(4)
    scripts = {"el": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450), "en": range(97, 123),
               "zh": range(0x4E00, 0x4E00 + 900), "ja": range(0x3041, 0x3097), "xx": range(0x20000, 0x20040)}
    samples = {}
    for name, points in scripts.items():
        words = ["".join(chr(rng.choice(points)) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
        samples[name] = [language.letters(" ".join(rng.choices(words, k=400 if name != "el" else 20)))]
    built = language.Languages(samples)
    texts = [samples[k][0][:700] for k in scripts] + [samples["zh"][0] * 3, " 漢 \U00020500 "]
    texts += ["".join(rng.choice("".join(s[0] for s in samples.values())) for _ in range(300))
              for _ in range(10)]
    for row, text in zip(built.phrases(texts), texts, strict=True):
        for k, name in enumerate(built.names):
            assert row[k] == brute_phrases(text, samples[name][0]), (text, name)
    names, _ = built.predict([samples[k][0][40:90] for k in scripts])
    assert names == list(scripts)


def test_matches_never_cross_a_gap():
    automaton = language.SuffixAutomaton([0, 1, -1, 0, 2, -1, 0, 1, 2])

    def holds(*codes):
        state = 0
        for code in codes:
            state = automaton.next[state].get(code)
            if state is None:
                return False
        return True

    assert holds(0, 1, 2) and holds(0, 2) and not holds(1, 0) and not holds(2, 0, 1)


def test_language_of_hard_rows(spark, edge, none):
    samples = {k: [language.letters(v)] for k, v in PROSE.items()}
    found = {(r.doc_id, r.text): r for r in language.predicted(edge, samples).collect()}
    assert len(found) == len(set(EDGE))
    for (_, text), row in found.items():
        assert (row.lang_pred == "und") == (not language.letters(text or ""))
        assert 0 <= row.score <= 1
    assert found[13, "."].lang_pred == "und" and found[14, "12 345"].lang_pred == "und"
    assert language.predicted(none, samples).count() == 0
    assert language.predicted(edge, {}).filter("lang_pred <> 'und'").count() == 0
    assert language.sampled(none.withColumn("lang", F.lit("x"))) == {}


def test_languages_are_learned(spark):
    rows = [(i, k, " ".join(random.Random(i).choices(v.split(), k=30)))
            for i, (k, v) in enumerate(list(PROSE.items()) * 40)]
    rows += [(900, None, "the cat"), (901, "xx", None), (None, "en", PROSE["en"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples = language.sampled(language.training_rows(docs))
    assert set(samples) == set(PROSE)
    assert all(len(p) <= language.PIECE + 2 for pieces in samples.values() for p in pieces)
    wrong = language.predicted(docs.filter("doc_id < 900"), samples).filter("lang <> lang_pred")
    assert wrong.count() == 0


def test_held_out_accuracy(spark, sf):
    found = language.op1_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.97


# Licences

def test_license_places(spark, edge, none):
    rows = [(101, "Licensed under the Apache License, Version 2.0."), (102, "GNU  General-Public\nLICENSE cc by"),
            (103, "mit license mit license"), (104, "the apache licenses"), (105, "all rights reserved"),
            *EDGE]
    found = licenses.scanned(spark.createDataFrame(rows, SCHEMA))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
               "mit license": "mit"}
    expected = []
    for doc_id, text in rows:
        w = TOKEN.findall((text or "").translate(LOWER))
        places = sorted((i, label) for phrase, label in phrases.items()
                        for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
        expected.append((doc_id, len(w), places))
    got = [(r.doc_id, r.n_words, sorted((p.start, p.label) for p in r.places if p.base))
           for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    labels = {r.doc_id: {p.label for p in r.places} for r in found.collect()}
    assert labels[101] >= {"apache", "apache-2.0"} and labels[105] == {"all-rights-reserved"}
    assert licenses.scanned(none).count() == 0
    assert licenses.scanned(edge).count() == len(EDGE)


def test_key_phrases_are_mandatory(spark):
    t = licenses.template("x", "alpha beta gamma delta epsilon zeta", "gamma delta")
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma xxx epsilon zeta"),
            (3, "alpha yyy gamma delta epsilon zeta"), (4, "gamma delta"), (5, "delta gamma beta")]
    found = licenses.scanned(spark.createDataFrame(rows, SCHEMA), (t,))
    assert {r.doc_id for r in found.collect() if r.places} == {1, 3}


def test_optional_words_may_be_altered_however_rare(spark):
    notice = "the gnu general public license version 3"
    rows = [(i, f"licensed under {notice}") for i in range(8)] + [(8, f"given with {notice}"),
            (9, f"given with {notice}"), (10, "licensed under the mit license version 3")]
    found = licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in found if "gpl-3.0" in {p.label for p in r.places}} == set(range(10))


def test_altered_notices_as_brute_force_and_sql(spark, tmp_path):
    """Notices of all templates with words altered, both of the rarest among them, and cut at either end."""
    rng, rows = random.Random(5), []
    for t in licenses.TEMPLATES:
        optional = [i for i in range(len(t.words)) if i not in t.mandatory]
        for k in range(12):
            words = list(t.words)
            changed = rng.sample(optional, min(k % 5, len(optional)))
            if k == 11:
                changed = [rng.choice(t.mandatory)]
            for i in changed:
                words[i] = f"odd{rng.randrange(3)}"
            around = [f"w{rng.randrange(5)}" for _ in range(k % 3)]
            text = around + words * (1 + k % 2) + around
            rows.append((len(rows), " ".join(text[1:] if k == 7 else text[:-1] if k == 8 else text)))
    rows += [(2000, None), (2001, ""), (2002, "license " * 3000 + "apache license")]
    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(1).write.parquet(path)

    weights = licenses.word_weights(docs.select("text"), licenses.TEMPLATES)
    expected = {}
    for doc_id, text in rows:
        w = TOKEN.findall((text or "").translate(LOWER))
        places = set()
        for t in licenses.TEMPLATES:
            for at in range(len(w) - len(t.words) + 1):
                same = [i for i, word in enumerate(t.words) if w[at + i] == word]
                share = sum(weights[t.words[i]] for i in same) / sum(weights[x] for x in t.words)
                if set(t.mandatory) <= set(same) and share >= licenses.SHARE:
                    places.add((at, t.label, round(share, 6)))
        expected[doc_id] = places
    found = licenses.scanned(docs).collect()
    assert {r.doc_id: {(p.start, p.label, round(p.share, 6)) for p in r.places} for r in found} == expected
    assert all(len(r.places) == len(expected[r.doc_id]) for r in found)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert compare(spark, con, licenses.op3_license_scan, licenses.ORACLE["op3_license_scan"],
                   str(tmp_path)) is None


# Decontamination

def test_contained_items(spark, edge, none):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n)))
             for i, n in enumerate([1, 3, 4, 5, 8, 20, 45, 90, 300, 1000])]
    items += [(100, None), (101, ""), (102, "..."), (None, "v1 v2 v3 v4 v5 v6")]
    docs = [*EDGE]
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.choice([5, 200, 2000]))
        _, text = rng.choice(items[:10])
        planted = [x if rng.random() > rng.choice([0, 0.01, 0.04]) else "zz" for x in text.split()]
        at = rng.randrange(len(w))
        docs.append((1000 + i, ", ".join(w[:at] + planted + w[at:]).upper()))
    docs += [(2000 + k, text) for k, (_, text) in enumerate(items)]
    given = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = ordered(contained(docs, items, 5, 80))
    assert len(expected) > 40
    assert ordered(contamination.contained_items(given, bench).collect()) == expected
    blocks = contamination.contained_items(given, bench, block_shingles=300)
    assert ordered(blocks.collect()) == expected
    assert contamination.contained_items(none, bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained_items(given, nothing).count() == 0
    assert contamination.decontaminated(edge, bench).columns == edge.columns
    left = {r.doc_id for r in contamination.decontaminated(given, bench).collect()}
    assert left == {i for i, _ in docs} - {r[0] for r in expected}


# Toxicity

def test_clauses_are_scored_by_what_holds_in_them():
    grammar = toxicity.Grammar({"idiot ": 2.0, "scum": 3.0})
    case = {name: grammar.features(text)[2:6] for name, text in {
        "plain": "a idiot here.", "target": "you idiot.", "negation": "not an idiot",
        "report": "she said idiot", "far": "not at all a good idea idiot", "other": "You. An idiot",
        "stem": "scumbags", "inside": "xscum idiots"}.items()}
    hit = [math.log1p(2.0)]
    assert case["plain"][:1] == hit and case["target"][1:2] == hit
    assert case["negation"][2:3] == hit and case["report"][3:] == hit
    assert case["far"][:1] == hit and case["other"][:1] == hit
    assert case["stem"][0] == math.log1p(3.0) and not any(case["inside"])


def test_long_clauses_are_read_whole_and_once():
    grammar = toxicity.Grammar({"idiot ": 2.0})
    far = "word " * 3000
    assert grammar.features(f"she said {far} idiot")[5] == math.log1p(2.0)
    assert grammar.features(f"you {far} idiot")[3] == math.log1p(2.0)
    many = grammar.features(f"idiot {'word ' * 900} idiot {'word ' * 900} idiot")
    assert many[2] == math.log1p(6.0) and many[9] == math.log1p(1)
    assert grammar.features("她 said 了。 idiot")[2] == math.log1p(2.0)


@pytest.mark.parametrize("text", [
    "I will kill you", "kill\nyou", "I will kill  you", "kill all of you", "he is killing you", "you'll pay",
    "you will surely die", "ich bringe dich noch um", "je vais vous frapper", "te voy a matar", "voy a matarte"])
def test_threats_are_sequences_of_words(text):
    found = toxicity.Grammar({}).features(text)
    assert sum(found[2:4]) == found[1] == math.log1p(toxicity.THREAT) and found[9] == math.log1p(1)


def test_features_come_from_what_holds():
    grammar = toxicity.Grammar({"idiot ": 2.0})
    none = grammar.features("he word word")
    for text, at in {"said he will kill you": 5, "not kill all of you": 4, "not idiot he": 4,
                     "said word idiot": 5, "said we kill\nyou": 5}.items():
        found = grammar.features(text)
        assert found[at] > 0 and [found[k] for k in (1, 6, 7, 8, 11)] == [0.0] * 5, text
    assert grammar.features("l'idiot")[2] == math.log1p(2.0) and none[1] == 0
    for text in ("kill. you", "kill\n\nyou", "kill one two three you", "skill you"):
        assert not any(grammar.features(text)[1:6]), text


def test_toxicity_of_hard_rows(spark, edge, none):
    model = toxicity.learned(none.withColumn("label", F.lit(1)))
    found = toxicity.scored(edge, model).collect()
    assert len(found) == len(EDGE) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scored(none, model).count() == 0
    bad = spark.createDataFrame([(1, "You are a stupid, pathetic idiot. You moron!")], SCHEMA)
    assert toxicity.scored(bad, model).first().score > 0.7


def test_repeated_ids_are_learned_from(spark):
    """Rows that share an id, or have none, are drawn one by one; equal rows count as one."""
    rows = [(k % 3 or None, "de" if k % 2 else "fr", f"{'der die das' if k % 2 else 'le la les'} x{'y' * (k % 50)}")
            for k in range(4000)]
    found = language.sampled(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert {lang: 0 < len(p) <= language.PIECES for lang, p in found.items()} == {"de": True, "fr": True}
    same = spark.createDataFrame([(2, "de", "der die das")] * 3000, "doc_id long, lang string, text string")
    assert language.sampled(same) == {"de": [" der die das "]}
    texts = [(7, f"you are an idiot number {k}" if k % 10 == 0 else f"a fine day number {k}", int(k % 10 == 0))
             for k in range(3000)]
    model = toxicity.learned(spark.createDataFrame(texts, "doc_id long, text string, label int"), rows=400)
    scores = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(
        [(1, "you idiot"), (2, "a fine evening")], SCHEMA), model).collect()}
    assert scores[1] > 0.7 > 0.3 > scores[2]


def test_rows_are_decontaminated_by_themselves(spark):
    leak = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, leak), (None, "clean text"), (5, leak), (5, "also clean"), (6, None)],
                                 SCHEMA)
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = contamination.decontaminated(docs, items).collect()
    assert sorted(r.text or "" for r in kept) == ["", "also clean", "clean text"]


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = toxicity.op8_toxicity(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in
              found.filter("quality = 1").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.9 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) < 0.02 * counts[0, 0]


# Pages

@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><head><title>t</title>", ""),
    ("<article><h1>A  &amp;\n b</h1><p>one<p>two<br>three</p></article><footer>f</footer>",
     "A & b\n\none\n\ntwo three"),
    ("<nav><a href='/'>Home</a></nav><main><p>Hello <b>there</b>, <a href=x>you</a> all of you</p></main>",
     "Hello there, you all of you"),
    ("<article><p>x</p><script>var a = '</p><p>no</p>';</script><style>p{}</style><p>y</p>", "x\n\ny"),
    ("<article><p>kept &lt;b&gt; &#233; &eacute;</p></article><div class='ad'>" + "buy " * 90 + "</div>",
     "kept <b> é é"),
    ("<article><p>a</p><aside>b</aside><div class=comments><p>c</p></div><form>d</form><p>e</p></article>",
     "a\n\ne"),
    ("<article><!-- <p>no</p> --><p>1 < 2", "1 < 2"),
    ("<article><p>cut off in a tag <a href='x", "cut off in a tag"),
])
def test_main_text(page, text):
    assert pages.main_text(page or "", pages.trained()) == text


def test_pages_without_an_article_go_by_density():
    prose = "word " * 60
    page = ("<div><a href=1>Home</a> <a href=2>About us</a></div>" + f"<div><p>{prose}</p><p>{prose}</p>"
            "</div><div><a href=3>More</a> <a href=4>of these</a></div>")
    assert pages.main_text(page, pages.trained()) == f"{prose.strip()}\n\n{prose.strip()}"


def test_tree_fits_its_table():
    tree = pages.trained()
    assert all((pages.share(tree, row[:-1]) > 0.5) == bool(row[-1]) for row in pages.LABELLED)


ARTICLE = ("<article><h1 class='post-header'>Title of it</h1><p>A paragraph with quite some words in it, "
           "so it is text.</p><p><a href=x>A paragraph that is wholly a link here</a></p><p>And another "
           "paragraph of the article that goes on for a while.</p></article>")
ARTICLE_TEXT = ("Title of it\n\nA paragraph with quite some words in it, so it is text.\n\nA paragraph that is "
                "wholly a link here\n\nAnd another paragraph of the article that goes on for a while.")


@pytest.mark.parametrize("wrapper, kept", [
    ("div class='overflow-hidden'", True), ("div data-hidden='x'", True),
    ("div class='content has-sidebar'", True), ("div class='comments-open single-post'", True),
    ("div class='social-news'", True), ("div class=sidebar", True), ("div", True),
    ("div hidden", False), ("div style='display: none'", False), ("aside", False)])
def test_wrappers_of_the_article(wrapper, kept):
    page = (f"<body><nav><a>Home</a></nav><{wrapper}>{ARTICLE}</{wrapper.split()[0]}>"
            "<footer>Imprint and more</footer></body>")
    assert pages.main_text(page, pages.trained()) == (ARTICLE_TEXT if kept else "")


def test_comments_short_pages_and_long_pages():
    tree = pages.trained()
    comment = "<article><p>I like this very much, thank you all for writing it down.</p></article>"
    assert pages.main_text(f"{ARTICLE}<div class='comment-list'>{comment}</div>", tree) == ARTICLE_TEXT
    assert pages.main_text("<nav><a>Home</a></nav><p>Two short words.</p><p>And three more here.</p>",
                           tree) == "Two short words.\n\nAnd three more here."
    links = "".join(f"<li><a>Item number {k}</a></li>" for k in range(9))
    assert pages.main_text(ARTICLE.replace("</article>", f"<ul>{links}</ul></article>"), tree) \
        == ARTICLE_TEXT
    long = "".join(f"<div><p>Paragraph {k} of a page that goes on and on.</p>" for k in range(20_000))
    assert pages.main_text(f"<main>{long}", tree).count("\n\n") == 19_999


def test_every_article_of_the_pages(spark, sf):
    import html
    import re

    given = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in pages.op9_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", given[row.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text)


def test_page_rows(spark):
    schema = "page_id long, url string, html string"
    given = spark.createDataFrame([(None, None, None), (1, "u", "<p>"), (1, "u", "<p>")], schema)
    assert [tuple(r) for r in pages.extracted(given.withColumn("text", F.lit(1))).collect()] == [
        (None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0)]
    assert pages.extracted(spark.createDataFrame([], schema)).count() == 0


# BPE

@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def ours():
    with open(TOKENIZER, "rb") as file:
        return bpe.WordBpe(file.read())


def same(ours, library, text: str) -> None:
    found = next(ours.encode([text]))
    ids = library.encode(text, add_special_tokens=False).ids
    assert [int(i) for w in found for i in w[0].split()] == ids
    assert " ".join(w[1] for w in found) == library.decode(ids, skip_special_tokens=False)
    assert sum(w[2] for w in found) == len(ids)


@pytest.mark.parametrize("text", [
    "", " \t\n", "Hello, WORLD!!!", "don't we'LL I'm", "<|startoftext|>a<|endoftext|>", "ΑΣ ΟΔΟΣ İ ǅ",
    "é é ﬁ", "a" * 64, "a" * 65, "a" * 66, "ab" * 5000, "!?" * 700, "12345 ½ ²", "漢字かな 😀👍🏽",
    "\x00\x01​ x", "<|startoftext|", "<|STARTOFTEXT|>"])
def test_encoding_as_the_library(ours, library, text):
    same(ours, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x24F), max_size=80))
def test_any_text_as_the_library(ours, library, text):
    same(ours, library, text)


def test_one_tree_and_many_trees_agree(ours):
    rng = random.Random(9)
    coded = ours.encoding
    for n in (2, 3, 5, 9, 17, 33, 65):
        symbols = [[rng.choice(coded.inside[97:110]) for _ in range(n)] for _ in range(50)]
        given = np.array(symbols)
        alive = coded.forest.run(given, np.full(50, n))
        for row, keeps, word in zip(given, alive, symbols, strict=True):
            assert row[keeps].tolist() == bpe.PairTree(list(word), coded.merges).run()


def test_encoded_rows(spark, edge, none, library):
    found = bpe.encoded(edge, TOKENIZER).collect()
    assert len(found) == len(EDGE)
    for row in found:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    digests = bpe.encoded(edge, TOKENIZER, ("ids_sha256", "decoded_sha256")).filter("doc_id = 2")
    assert digests.first().ids_sha256 == sha("")
    assert bpe.encoded(none, TOKENIZER).count() == 0


# Pipeline

def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rows = [(1, PROSE["en"] * 3, "en"), (2, PROSE["en"] * 3 + "\n", "en"), (3, "...", "en"),
            (4, None, "de"), (5, PROSE["de"] * 2, "de"), (6, "x " + PROSE["fr"] * 9 + " y", "fr"),
            (7, PROSE["fr"] * 9 + " z", "fr"), (8, "leak: one two three four five six seven", "en"),
            (9, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {2, 5, 6, 9}
    assert all(r.n_tokens == len(r.ids) for r in found)


@pytest.mark.parametrize("lang", [None, "und"])
def test_documents_stay_where_no_language_is_learned(spark, lang):
    rows = [(1, PROSE["en"], lang), (2, PROSE["de"], lang), (3, "...", lang), (4, None, lang),
            (5, "漢字", lang), (6, "", lang), (None, "x", lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = corpus_pipeline.language_id(spark, docs, "")
    assert {r.doc_id for r in found.collect()} == {1, 2, 5, None} and found.columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_keeps_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
