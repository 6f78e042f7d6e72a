"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags.  Each block has a word count and a link
density (share of its words inside links), and sees those of its neighbours.  Blocks in furniture (menus,
footers, adverts, reader comments) are out; of the others a decision tree, grown from the small labelled
table below, tells main text from the rest by these figures, and by whether the block lies in an article
and the page has one.

Regions go by elements, by hidden ones, and by the class names that say what an element is: a class that
tells what a page has ("has-sidebar", "comments-open") is none, a heading's class changes nothing, and a
class around the only article of a page does not make it furniture.  A page without an article and
without a block that the tree takes has all it says outside of furniture and links as its text.

Every page is read whole, in one task, in time linear in its length; nothing is shuffled.

Defined cases: null, empty and textless pages give an empty text; cut-off pages and tags that were
never closed end with the page; repeated rows give equal rows; an empty table gives an empty result;
null ids and urls are carried; other columns are not touched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import words
from lanewise.llm.common import table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements whose content is never text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
SKIPPED = frozenset("head svg math select button object canvas audio video form datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside header menu dialog".split())
ARTICLE_WORDS = frozenset(
    "article articlebody content entry main post story text".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs "
    "byline comment comments consent cookie cookies copyright disqus footer gdpr header masthead "
    "menu modal nav navbar navigation newsletter notice notification overlay pagination popup "
    "promo promoted related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe tags teaser toolbar widget".split())

# Names that tell what a page has, not what the element is: "has-sidebar", "comments-open".
STATE_WORDS = frozenset("has with no without is not show hide open closed enabled disabled on off".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after",
            "in_article", "page_has_article")

# The labelled table: features of a block, and whether it is main text.  Fixed values.
LABELLED = (
    # inside an article: long and short paragraphs, headings, the first and the last block
    (9, 0.0, 22, 0.0, 40, 0.0, 1, 1, 1), (60, 0.0, 9, 0.0, 35, 0.02, 1, 1, 1),
    (1, 0.0, 120, 0.0, 1, 0.0, 1, 1, 1), (1, 0.0, 1, 0.0, 80, 0.0, 1, 1, 1),
    (3, 0.0, 8, 0.0, 6, 0.0, 1, 1, 1), (25, 0.1, 60, 0.0, 12, 0.0, 1, 1, 1),
    (40, 0.2, 3, 0.0, 2, 1.0, 1, 1, 1), (14, 0.35, 50, 0.0, 44, 0.0, 1, 1, 1),
    (300, 0.0, 0, 0.0, 5, 0.0, 1, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1),
    (70, 0.05, 5, 0.0, 1, 1.0, 1, 1, 1), (2, 0.0, 30, 0.0, 7, 1.0, 1, 1, 1),
    (8, 0.0, 4, 1.0, 90, 0.0, 1, 1, 1), (18, 0.45, 30, 0.1, 33, 0.0, 1, 1, 1),
    (6, 0.5, 40, 0.0, 50, 0.0, 1, 1, 1), (120, 0.0, 14, 0.0, 0, 0.0, 1, 1, 1),
    # text beside links: after a menu or a linked paragraph, before a footer's links
    (3, 0.0, 1, 1.0, 15, 0.0, 1, 1, 1), (14, 0.0, 9, 1.0, 4, 0.0, 1, 1, 1),
    (12, 0.0, 8, 1.0, 4, 1.0, 1, 1, 1), (5, 0.0, 2, 1.0, 30, 0.0, 1, 1, 1),
    (20, 0.0, 3, 1.0, 9, 1.0, 1, 1, 1), (2, 0.0, 5, 1.0, 2, 1.0, 1, 1, 1),
    (40, 0.1, 1, 1.0, 1, 1.0, 1, 1, 1), (1, 0.0, 4, 0.9, 60, 0.3, 1, 1, 1),
    # a paragraph that is wholly a link, between paragraphs
    (6, 1.0, 40, 0.0, 35, 0.0, 1, 1, 1), (12, 1.0, 25, 0.0, 18, 0.0, 1, 1, 1),
    (4, 1.0, 60, 0.1, 50, 0.0, 1, 1, 1), (3, 1.0, 9, 0.0, 12, 0.0, 1, 1, 1),
    (8, 1.0, 12, 0.0, 12, 0.0, 1, 1, 1), (10, 1.0, 14, 0.0, 30, 0.0, 1, 1, 1),
    (5, 1.0, 18, 0.0, 9, 0.0, 1, 1, 1), (2, 1.0, 30, 0.0, 14, 0.0, 1, 1, 1),
    (9, 0.9, 10, 0.0, 20, 0.1, 1, 1, 1), (7, 1.0, 80, 0.0, 10, 0.0, 1, 1, 1),
    # lists of links inside an article
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 1, 1, 0),
    (2, 1.0, 3, 1.0, 9, 0.0, 1, 1, 0), (12, 0.95, 8, 0.9, 10, 1.0, 1, 1, 0),
    (3, 1.0, 0, 0.0, 2, 1.0, 1, 1, 0), (9, 0.9, 30, 0.0, 0, 0.0, 1, 1, 0),
    (3, 1.0, 4, 1.0, 40, 0.0, 1, 1, 0), (5, 1.0, 2, 1.0, 25, 0.0, 1, 1, 0),
    (4, 1.0, 6, 1.0, 90, 0.0, 1, 1, 0), (6, 1.0, 50, 0.0, 14, 1.0, 1, 1, 0),
    (4, 1.0, 12, 1.0, 5, 1.0, 1, 1, 0), (6, 1.0, 15, 0.0, 7, 1.0, 1, 1, 0),
    (5, 1.0, 20, 0.9, 30, 0.0, 1, 1, 0), (7, 0.9, 12, 1.0, 40, 0.0, 1, 1, 0),
    # outside the article of a page that has one
    (3, 1.0, 15, 0.0, 10, 0.0, 0, 1, 0), (8, 1.0, 20, 0.0, 15, 0.0, 0, 1, 0),
    (6, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0), (2, 0.8, 12, 0.0, 60, 0.0, 0, 1, 0),
    (20, 0.0, 1, 1.0, 30, 0.0, 0, 1, 0), (6, 0.0, 40, 0.0, 3, 0.0, 0, 1, 0),
    (90, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 1, 0),
    (15, 0.0, 4, 0.0, 60, 0.0, 0, 1, 0), (9, 0.0, 2, 1.0, 120, 0.0, 0, 1, 0),
    (40, 0.0, 3, 1.0, 80, 0.0, 0, 1, 0), (5, 0.0, 0, 0.0, 300, 0.0, 0, 1, 0),
    (4, 0.0, 70, 0.0, 50, 0.0, 0, 1, 0), (2, 0.0, 25, 0.0, 40, 0.0, 0, 1, 0),
    # pages without an article element: text density decides
    (45, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1), (20, 0.05, 3, 1.0, 55, 0.0, 0, 0, 1),
    (16, 0.0, 40, 0.1, 2, 1.0, 0, 0, 1), (80, 0.2, 0, 0.0, 0, 0.0, 0, 0, 1),
    (5, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1), (3, 0.0, 70, 0.0, 45, 0.0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 48, 0.0, 0, 0, 1), (4, 0.0, 0, 0.0, 38, 0.0, 0, 0, 1),
    (6, 0.0, 35, 0.0, 4, 0.0, 0, 0, 1), (12, 0.0, 25, 0.0, 22, 0.0, 0, 0, 1),
    (2, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0),
    (7, 0.0, 1, 1.0, 4, 0.9, 0, 0, 0), (5, 0.0, 9, 0.5, 3, 0.0, 0, 0, 0),
    (3, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0), (9, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (10, 0.9, 40, 0.0, 35, 0.0, 0, 0, 0),
    (25, 0.8, 8, 0.7, 30, 0.1, 0, 0, 0), (60, 0.6, 50, 0.5, 20, 0.9, 0, 0, 0),
    (3, 1.0, 12, 0.0, 40, 0.0, 0, 0, 0), (7, 1.0, 22, 0.0, 18, 0.0, 0, 0, 0),
    (15, 0.5, 3, 1.0, 4, 1.0, 0, 0, 0), (4, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0),
)

Tree = tuple  # (feature, limit, tree up to the limit, tree above it), or (share of main text,)


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """A binary tree by Gini impurity; the first of equally good splits."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        value, label = x[order, feature], y[order]
        left = np.cumsum(label)[:-1]
        n = np.arange(1, len(y))
        right, m = label.sum() - left, len(y) - n
        impurity = left * (n - left) / n + right * (m - right) / m
        impurity[(value[1:] == value[:-1]) | (n < least) | (m < least)] = np.inf
        at = int(np.argmin(impurity))
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-12):
            best = (impurity[at], feature, float(value[at] + value[at + 1]) / 2)
    if best is None:
        return (float(y.mean()),)
    _, feature, limit = best
    low = x[:, feature] <= limit
    return (feature, limit, grown(x[low], y[low], depth - 1, least),
            grown(x[~low], y[~low], depth - 1, least))


def trained() -> Tree:
    rows = np.array(LABELLED, float)
    return grown(rows[:, :-1], rows[:, -1])


def share(tree: Tree, x: tuple) -> float:
    while len(tree) > 1:
        feature, limit, low, high = tree
        tree = low if x[feature] <= limit else high
    return tree[0]


def _names(value: str) -> Iterator[frozenset[str]]:
    """The words of each class name that say what the element is."""
    for name in value.lower().split():
        found = frozenset(re.split(r"[^a-z0-9]+", name))
        if not found & STATE_WORDS:
            yield found


def _region(name: str, attributes: str, inside: int) -> int:
    """1 for an element that begins an article, 2 for furniture, 4 for furniture by its class alone, 0
    for neither.

    A header inside an article heads the article, and so does a heading whatever its class.
    """
    if name in ARTICLE:
        return 1
    if name in FURNITURE:
        return 0 if name == "header" and inside else 2
    if not attributes or name in ("body", "html"):
        return 0
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(
            given.get("style", "")):
        return 2
    if name in HEADINGS:
        return 0
    found = [w for key in ("class", "id", "role") if key in given for w in _names(given[key])]
    if any(w & FURNITURE_WORDS for w in found):
        return 4
    return 1 if any(w & ARTICLE_WORDS for w in found) else 0


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks in page order: (text, words, words in links, in an article, in furniture, in an article
    element that only a class above it makes furniture)."""
    found: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with their regions
    articles = furniture = named = skipped = links = 0
    wrapped: list[int] = []  # class furniture above each article that lies in such
    held: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            found.append((text, text.count(" ") + 1, linked, articles > 0, furniture + named > 0,
                          bool(wrapped) and not furniture and named == wrapped[-1]))
        held, linked = [], 0

    def leave(place: int) -> None:
        nonlocal articles, furniture, named, skipped
        for _, region in stack[place:]:
            articles -= region in (1, 5)
            furniture -= region == 2
            skipped -= region == 3
            named -= region == 4
            if region == 5:
                wrapped.pop()
        del stack[place:]

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        match = _TAG.match(page, tag) if tag >= 0 else None
        end = n if tag < 0 else tag if match else tag + 1
        if end > at and not skipped:
            text = page[at:end]
            if "&" in text:
                text = html.unescape(text)
            held.append(text)
            if links:
                linked += len(text.split())
        if tag < 0:
            break
        if not match:
            at = tag + 1
            continue
        at = match.end()
        if not match[2]:
            continue
        name, closing = match[2].lower(), bool(match[1])
        if name in RAW:
            if not closing:
                rest = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = n if rest is None else page.find(">", rest.start()) + 1 or n
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            held.append(" ")
        if name in INLINE:
            continue
        close()
        if closing:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == name:
                    leave(place)
                    break
        elif name not in VOID:
            links = 0
            region = 3 if name in SKIPPED else _region(name, match[3], articles)
            # an article begun inside furniture is furniture, and elements that no region depends
            # on are kept too, so that closing tags meet their own
            if name != "p":
                if name in ARTICLE and named and not furniture:
                    region = 5
                    wrapped.append(named)
                stack.append((name, region))
                articles += region in (1, 5)
                furniture += region == 2
                skipped += region == 3
                named += region == 4
    close()
    return found


def main_text(page: str, tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by empty lines."""
    found = blocks(page)
    has_article = any(b[3] and not b[4] for b in found)
    if not has_article and any(b[5] for b in found):  # a class does not take the only article away
        found = [(*b[:3], True, False, True) if b[5] else b for b in found]
        has_article = True
    seen = [(0, 0.0), *((b[1], min(1.0, b[2] / b[1])) for b in found), (0, 0.0)]
    chosen = [b[0] for i, b in enumerate(found)
              if not b[4] and share(
                  tree, (*seen[i + 1], *seen[i], *seen[i + 2], b[3], has_article)) > 0.5]
    if not chosen and not has_article:  # a page of few words: all it says outside of furniture
        chosen = [b[0] for i, b in enumerate(found) if not b[4] and seen[i + 1][1] < 0.5]
    return "\n\n".join(chosen)


def _extractor(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2)
            for begin, end in words.batches(words.sizes(pages)):
                texts = [main_text(p or "", tree)
                         for p in pages.slice(begin, end - begin).to_pylist()]
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
    return run


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return given.mapInArrow(_extractor(trained()),
                            "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
