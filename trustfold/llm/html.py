"""Main text of web pages by a maximum-scoring run of tokens.

A page becomes a sequence of tokens: tags, and pieces of text under the nearest
section or named element that holds them. Words score positive and tags negative;
how much is learned from labelled pages, by the log odds of a token's kind inside
and outside the labelled content. A kind tells the element, for text also whether
its block is mostly links; a kind that no labelled page has falls back on the tag
alone, or on text of any place. One linear scan finds the run of tokens with the
largest sum.

Some elements are never content: menus, forms, sidebars and footers by their tag,
adverts, notices, comments and the like by a class, id or role that the labelled
pages have outside their content. For names that they lack there is a prior: a
name made up of boiler words only. Such elements cost the run little, since an
advert may stand within an article, and are left out of the result.

Pages that mark their content with one <article> or <main> element are the
labelled ones. Their counts are sums over all pages, kept in a hashed table of
fixed size, so the model does not grow with the crawl.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 16
#: Elements without text, elements that begin a block, elements that hold a part of the page, and those that give its text a kind.
SILENT = frozenset("script style noscript template svg annotation annotation-xml head title iframe object canvas select textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
STRUCTURE = frozenset("html body div section article main nav header footer aside form ul ol table figure blockquote details dialog".split())
SECTION = STRUCTURE - frozenset("ul ol table figure blockquote details".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Never content: by element; and the prior for a class, id or role that no labelled page has, all of whose words must be listed.
BOILER_TAGS = frozenset("nav footer aside form dialog button menu".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended comment comments disqus respond reply replies form search widget toolbar pagination pager "
    "contentinfo complementary".split())

#: Words that say nothing themselves beside a boiler word.
FILLER_WORDS = frozenset(
    "site page global top bottom left right main list item items box bar block container wrapper wrap section area inner outer content slot unit "
    "user reader users readers links link buttons button posts articles stories js id".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Token:
    """A tag (words 0) or a piece of text with its kind and the kind to fall back on; block numbers the block it belongs to.

    names: classes, ids and roles of the elements that hold it. boiler: one of them is never content by its tag. inside: it lies
    in an article or main element, which only the labels use.
    """

    kind: str
    words: int = 0
    text: str = ""
    block: int = 0
    boiler: bool = False
    inside: bool = False
    plain: str = ""
    names: tuple[str, ...] = ()


@dataclass(slots=True)
class _Open:
    """An open element; all but the tag hold for its ancestors, too."""

    tag: str
    near: str
    boiler: bool
    content: bool
    names: tuple[str, ...]


_PAGE = _Open("", "", False, False, ())


def _names(attrs: str) -> list[str]:
    return sorted({w for m in _ATTR.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().split()})


@lru_cache(maxsize=1 << 14)
def listed(name: str) -> bool:
    """Whether a name is made up of boiler words, with or without filler words."""
    words = _WORD.findall(name)
    return any(w in BOILER_WORDS for w in words) and all(w in BOILER_WORDS or w in FILLER_WORDS for w in words)


def tokens(page: str) -> list[Token]:
    """Tokens of a page in order. Unclosed elements end with the page or with their parent, stray ends are tags only."""
    stack: list[_Open] = []
    out: list[Token] = []
    linked: dict[int, int] = {}  # words by block: less those in links
    block, at, silent, links = 0, 0, "", 0

    def piece(raw: str) -> None:
        o = stack[-1] if stack else _PAGE
        n = len(raw.split())
        linked[block] = linked.get(block, 0) + (-n if links else n)
        out.append(Token("text:" + o.near, n, raw, block, o.boiler, o.content, "text:*", o.names))

    for m in _TOKEN.finditer(page):
        if not silent and m.start() > at:
            piece(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, end = m.group(2).lower(), bool(m.group(1))
        if silent:
            if not (end and tag == silent) and not (silent == "head" and tag in ("/head", "body")):
                continue
            silent = ""
            if end:
                continue
        if tag in SILENT and not end:
            if not m.group(3).rstrip().endswith("/"):
                silent = tag
            continue
        if tag in BLOCK:
            block, links = block + 1, 0
        elif tag == "a":
            links = 0 if end else 1
        before = parent = stack[-1] if stack else _PAGE
        if tag in STRUCTURE or tag in BOILER_TAGS:
            if end:
                if any(o.tag == tag for o in stack):
                    while stack.pop().tag != tag:
                        pass
                    parent = stack[-1] if stack else _PAGE
            elif tag not in VOID:
                if tag in CONTENT:  # content cannot lie in an element that someone forgot to close
                    for o in stack:
                        o.boiler, o.names = False, ()
                whole = tag in ("html", "body") or tag in CONTENT
                names = () if whole else tuple(_names(m.group(3)))
                boiler = tag in BOILER_TAGS or (tag == "header" and not parent.content)
                near = ".".join((tag, *names)) if tag in SECTION or names else parent.near
                stack.append(_Open(tag, near, parent.boiler or boiler, parent.content or tag in CONTENT, parent.names + names))
                before = stack[-1]
        name = "tag:" + ("/" if end else "") + tag
        inside = before.content and tag not in CONTENT
        out.append(Token(f"{name}<{parent.near}", block=block, boiler=before.boiler, inside=inside, plain=name, names=before.names))
    if not silent and at < len(page):
        piece(page[at:])
    for t in out:
        if t.text and linked[t.block] < 0:
            t.kind, t.plain = t.kind + "@a", t.plain + "@a"
    return out


@lru_cache(maxsize=1 << 14)
def cell(kind: str) -> int:
    return xxhash.xxh32_intdigest(kind) % CELLS


# --- weights --------------------------------------------------------------------

PRIOR = 0.5
LIMIT = 8.0
LEAST_TAG = -0.05
MOST_TAG = -0.5  # of tags that no labelled page has in their place
LEAST_WORD = 0.25  # of text that is not mostly links, in a place that no labelled page has
NAME = -2.0  # elements with a name of this weight or less are left out
LEFT_OUT = -0.25  # a word that is left out


def learn(pages: DataFrame, html_col: str = "html") -> tuple[np.ndarray, np.ndarray]:
    """(weights, seen) by cell: log odds of a token's kind, and of an element's name, inside and outside the content of labelled
    pages; seen is false for what no labelled page has. The result has CELLS entries whatever the number of pages."""

    def run(batches):
        inside, outside = Counter(), Counter()
        for pdf in batches:
            for page in pdf["html"]:
                if page and len(re.findall(r"<article[\s>]", page)) + len(re.findall(r"<main[\s>]", page)) == 1:
                    for t in tokens(page):
                        if t.words or not t.text:
                            n = max(1, t.words)
                            side = inside if t.inside and not t.boiler else outside
                            side[cell(t.kind)] += n
                            if not (t.boiler or any(map(listed, t.names))):
                                side[cell(t.plain)] += n
                            for name in {*t.names} if t.text else ():
                                side[cell("name:" + name)] += n
        yield pd.DataFrame([(c, inside[c], outside[c]) for c in {*inside, *outside}], columns=["cell", "n_in", "n_out"])

    rows = pages.select(F.col(html_col).alias("html")).mapInPandas(run, "cell int, n_in long, n_out long")
    got = rows.groupBy("cell").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).collect()  # at most CELLS rows
    weights, seen = np.zeros(CELLS), np.zeros(CELLS, dtype=bool)
    for r in got:
        w = math.log((r["n_in"] + PRIOR) / (r["n_out"] + PRIOR))
        weights[r["cell"]], seen[r["cell"]] = max(-LIMIT, min(LIMIT, w)), True
    return weights, seen


def left_out(t: Token, weights: np.ndarray, seen: np.ndarray) -> bool:
    """Whether an element that holds the token is never content: by its tag, or by a name's weight and prior."""
    return t.boiler or any(weights[cell("name:" + n)] * seen[cell("name:" + n)] - LIMIT * listed(n) <= NAME for n in t.names)


def score(t: Token, out: bool, weights: np.ndarray, seen: np.ndarray) -> float:
    """Of a piece of text, its words' sum; of a tag, a negative number. ``out``: it is left out of the result."""
    if out:
        return LEFT_OUT * t.words if t.text else LEAST_TAG
    c, p = cell(t.kind), cell(t.plain)
    if t.text:
        if seen[c]:
            return float(weights[c]) * t.words
        if t.plain == "text:*":
            return (max(float(weights[p]), LEAST_WORD) if seen[p] else 1.0) * t.words
        return (float(weights[p]) if seen[p] else -1.0) * t.words
    if seen[c]:
        return min(float(weights[c]), LEAST_TAG)
    if seen[p]:
        return max(MOST_TAG, min(float(weights[p]), LEAST_TAG))
    return MOST_TAG if t.plain.removeprefix("tag:").lstrip("/") in BLOCK else LEAST_TAG


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest positive sum, the first of equals; (0, 0) if there is none."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def main_text(page: str | None, weights: np.ndarray, seen: np.ndarray) -> str:
    """Blocks of the best run, one to a line, references decoded and white space turned into single spaces."""
    if not page:
        return ""
    all_tokens = tokens(page)
    out = [left_out(t, weights, seen) for t in all_tokens]
    start, end = best_run([score(t, o, weights, seen) for t, o in zip(all_tokens, out)])
    blocks: dict[int, list[str]] = {}
    for t, o in zip(all_tokens[start:end], out[start:end]):
        if t.text and not o:
            blocks.setdefault(t.block, []).append(t.text)
        elif t.plain == "tag:br":
            blocks.setdefault(t.block, []).append(" ")
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, labelled: DataFrame | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the main text (empty if none), and n_chars, its code points.

    ``labelled``: pages to learn from, all of ``pages`` if None; those without exactly one article or main element teach nothing. A null
    or empty page has the empty text. Repeated rows stay repeated, extra columns pass through. Pages of any length are
    read whole.
    """
    taken = {out_col, "n_chars"} & set(pages.columns)
    if taken:
        raise ValueError(f"rename these columns first: {sorted(taken)}")
    weights, seen = learn(labelled if labelled is not None else pages, html_col)
    model = pages.sparkSession.sparkContext.broadcast((weights, seen))  # CELLS numbers

    @F.pandas_udf(T.StringType())
    def run(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, *model.value) for p in page], dtype=object)

    return pages.withColumn(out_col, run(F.col(html_col))).withColumn("n_chars", F.length(out_col).cast("long"))
