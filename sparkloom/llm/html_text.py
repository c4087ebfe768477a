"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words, block by block, and tags. A word scores the log odds of main text given the elements that
it stands in, what their attributes call them, and whether its block is all links: positive, unless these speak against
it; tags score negative, the more
the rarer they were in main text. One linear scan finds the contiguous region of blocks with the highest total, and its
blocks are the text, without elements that by themselves speak for boilerplate, such as an advert in an article, and
without hidden ones. All weights are learned from labelled pages.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import Sparse, fit_logistic
from ._shared import missing_as_null, rows_of
from .labelled_pages import PAGES

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noframes", "noembed", "select", "button", "object", "audio", "video", "canvas", "math")
#: Elements whose end may be left out, and what ends them besides their parent's end.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_PART = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
#: Elements that hold text itself, rather than parts of a page: what their attributes say is told apart.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption label legend".split())
#: Elements that wrap anything, and so say nothing by themselves.
WRAPPERS = frozenset(("html", "body", "div", "span", "main-text-start", "main-text-end"))
#: Elements are boilerplate by themselves from these log odds down, and speak for main text from those up; bounds of a word's and of a tag's score.
BOILERPLATE, CONTENT, WORD_SCORE, TAG_SCORE = -1.0, 1.0, (-3.0, 2.0), (-0.4, -0.02)
#: Log odds of a word of which nothing is known: words are main text unless something speaks against it.
PRIOR = 1.0


class Element:
    """An open element: its features, the one it stands in, and whether what speaks for main text stands in it.

    ``holder`` is the nearest element that isn't inline, itself or around it; ``link`` and ``skip`` say whether an inline
    element from there on is a link, or hidden; ``base`` is the holder's place among the open elements.
    """

    __slots__ = ("base", "features", "hidden", "holder", "holds", "inside", "left_out", "link", "parent", "skip", "tag")

    def __init__(self, tag: str, rest: str, parent: Element | None, place: int = 0):
        self.tag, self.parent, self.holds = tag, parent, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.left_out = (parent is not None and parent.left_out) or "data-left-out" in rest
        self.hidden = bool(rest) and _HIDDEN.search(rest) is not None
        names = {x for m in _NAMES.findall(rest) for x in _SPLIT.split("".join(m).lower()) if x} if rest and tag not in ("html", "body") else ()
        mark = "~" if tag in TEXTUAL else "."
        own = () if tag in WRAPPERS else (tag + "@" if self.inside and tag not in TEXTUAL else tag,)
        self.features = (*own, *(mark + x for x in sorted(names)))
        if tag in INLINE:
            self.holder, self.base = (parent.holder, parent.base) if parent is not None else (None, -1)
            self.link, self.skip = tag == "a" or (parent is not None and parent.link), self.hidden or (parent is not None and parent.skip)
        else:
            self.holder, self.base, self.link, self.skip = self, place, False, False


#: Tags with broken quotes until which quotes are heeded; a page with more is read without.
BROKEN = 20
_PLAIN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)()()()", re.S)


def parts(page: str, elements: list[Element] | None = None) -> Iterator[tuple[str, str, Element | None]]:
    """("text" or "open" or "close", words or tag, innermost open element) in page order, without raw elements; all elements go to ``elements``.

    Every step takes constant time, or ends what it walks over, so a page of any markup is read in linear time.
    """
    stack: list[Element] = []
    many: Counter = Counter()  # open elements by tag

    def end_from(i: int) -> None:
        for e in stack[i:]:
            many[e.tag] -= 1
        del stack[i:]

    at, n, part, broken, endless = 0, len(page), _PART, 0, set()
    while at < n:
        lt = page.find("<", at)
        m = part.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a bare less-than sign is text
            lt = page.find("<", lt + 1)
            m = part.match(page, lt) if lt >= 0 else None
        end = n if lt < 0 else lt
        if end > at:
            yield "text", page[at:end], stack[-1] if stack else None
        if m is None:
            return
        at = m.end()
        tag, close, rest = (m[2] or m[5]), (m[1] or m[4]), (m[3] or m[6] or "")
        if not tag:
            continue
        if m[5]:
            broken += 1
            part = _PLAIN if broken > BROKEN else part
        tag = tag.lower()
        if close:
            if many[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                end_from(i)
            yield "close", tag, stack[-1] if stack else None
            continue
        if tag in _ENDS and not rest.rstrip().endswith("/"):
            done = None if tag in endless else _ENDS[tag].search(page, at)
            if done is None:
                endless.add(tag)
                if tag in ("script", "style"):
                    return
                continue
            after = page.find(">", done.start())
            at = n if after < 0 else after + 1
            continue
        if tag not in VOID:
            ended = CLOSES.get(tag, "p" if tag not in INLINE else "").split()
            if ended and stack and stack[-1].base >= 0 and stack[stack[-1].base].tag in ended:
                end_from(stack[-1].base)
            if not rest.rstrip().endswith("/"):
                stack.append(Element(tag, rest, stack[-1] if stack else None, len(stack)))
                many[tag] += 1
                if elements is not None:
                    elements.append(stack[-1])
        yield "open", tag, stack[-1] if stack else None


class Block:
    """A run of text between block-level tags, with the element it stands in and how many of its words are links."""

    __slots__ = ("element", "links", "text", "words")

    def __init__(self, element: Element | None):
        self.element, self.text, self.words, self.links = element, [], 0, 0

    def features(self) -> set[str]:
        out, at = set(), self.element
        while at is not None:
            out.update(at.features)
            at = at.parent
        if self.words and self.links >= 0.8 * self.words:
            out.add("links")
        return out


def blocks(page: str, elements: list[Element] | None = None) -> Iterator[tuple[str, Block | None]]:
    """("", block) or (block-level tag, None) in page order. A block is of one innermost element that isn't inline."""
    own: Block | None = None
    for kind, what, element in parts(page, elements):
        if kind == "text":
            if own is None:
                own = Block(element.holder if element is not None else None)
            if element is None or not element.skip:
                n = len(what.split())
                own.text.append(what)
                own.words += n
                own.links += n if element is not None and element.link else 0
        elif what not in INLINE:
            if own is not None:
                yield "", own
            own = None
            yield what, None
        elif what == "br" and own is not None:
            own.text.append(" ")
    if own is not None:
        yield "", own


class Weights:
    """What labelled pages teach: log odds of main text for features of elements and of blocks, and scores of tags."""

    def __init__(self, pages: tuple[str, ...]):
        rows, tag_in, tag_out = [], Counter(), Counter()
        for page in pages:
            main = False
            for tag, block in blocks(page.replace("[[", "<main-text-start/>").replace("]]", "<main-text-end/>")):
                if tag in ("main-text-start", "main-text-end"):
                    main = tag == "main-text-start"
                elif block is None:
                    (tag_in if main else tag_out)[tag] += 1
                elif block.words:
                    rows.append((block.features(), main and not (block.element is not None and block.element.left_out), block.words))
        names = sorted(set().union(*(f for f, *_ in rows)))
        place = {f: i for i, f in enumerate(names)}
        row, col = np.repeat(np.arange(len(rows)), [len(f) for f, *_ in rows]), np.array([place[x] for f, *_ in rows for x in sorted(f)], int)
        size = np.sqrt([min(n, 20) for *_, n in rows])
        w, _ = fit_logistic(Sparse(row, col, np.ones(len(col)), len(rows), len(names)), np.array([main for _, main, _ in rows], float), size, l2=0.1, steps=600, intercept=PRIOR)
        self.of = {f: float(x) for f, x in zip(names, w, strict=True)}
        odds = {t: math.log((tag_out[t] + 1) / (tag_in[t] + 1)) / 4 for t in tag_in | tag_out}
        self.tag = {t: max(TAG_SCORE[0], min(TAG_SCORE[1], -x)) for t, x in odds.items()}

    def element(self, e: Element) -> float:
        return sum(self.of.get(f, 0.0) for f in e.features)


@cache
def default_weights() -> Weights:
    return Weights(PAGES)


def best_region(scores: np.ndarray) -> tuple[int, int] | None:
    """(start, end) of the first contiguous region with the highest sum, or None if no sum is above 0."""
    if not len(scores):
        return None
    run = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(run[:-1])
    end = int(np.argmax(run[1:] - low))
    return (int(np.argmin(run[: end + 1])), end + 1) if run[end + 1] > low[end] else None


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The main text: blocks joined by line feeds, white space inside a block as one space."""
    weights = weights or default_weights()
    elements: list[Element] = []
    items = list(blocks(page or "", elements))
    judged: dict[Element | None, tuple[float, bool]] = {None: (0.0, False)}  # log odds of all elements from this one outwards, whether any is left out
    own = [weights.element(e) for e in elements]
    for e, odds in zip(elements, own, strict=True):
        if e.tag == "h1" or (odds >= CONTENT and e.tag not in TEXTUAL):
            at = e.parent
            while at is not None and not at.holds:
                at.holds, at = True, at.parent
    for e, odds in zip(elements, own, strict=True):  # outer elements come first
        above, out = judged[e.parent]
        odds = max(0.0, odds) if e.holds else odds  # what holds the main text may be called anything
        judged[e] = (above + odds, out or e.hidden or (odds <= BOILERPLATE and e.tag not in TEXTUAL))
    scores, left_out = np.zeros(len(items)), False
    texts: list[str | None] = [None] * len(items)
    for i, (tag, block) in enumerate(items):
        if block is None:
            scores[i] = 0.0 if left_out else weights.tag.get(tag, TAG_SCORE[0])
            continue
        odds, left_out = judged[block.element]
        if left_out or not block.words:
            continue
        texts[i] = "".join(block.text)
        odds += PRIOR + (weights.of.get("links", 0.0) if block.links >= 0.8 * block.words else 0.0)
        scores[i] = block.words * min(WORD_SCORE[1], max(WORD_SCORE[0], odds))
    if (region := best_region(scores)) is None:
        return ""
    found = (" ".join(_html.unescape(t).split()) for t in texts[slice(*region)] if t)
    return "\n".join(b for b in found if b)


def _extracted(weights: Weights | None):
    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [extract(p, weights) for p in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": text, "n_chars": np.fromiter(map(len, text), np.int64, len(text))})

    return extracted


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] | None = None) -> DataFrame:
    """The main text of every page: ``id_col``, ``url_col``, ``text``, ``n_chars`` (code points); one row for each of ``pages``.

    ``labelled`` are pages to learn from, with their main text between [[ and ]]; ``labelled_pages.PAGES`` by default. A
    null or empty page, or one without any word that scores, has the empty text. Of regions that score alike the first
    counts. Pages of any length are scanned once, from end to end, a page in one task. Null ids and urls stay; repeated
    rows each get a row; an empty table gives an empty result. Other columns are ignored.
    """
    kinds = dict(pages.dtypes)
    rows = rows_of(pages, id=id_col, url=missing_as_null(pages, url_col, "string"), html=html_col)
    out = rows.mapInPandas(_extracted(Weights(labelled) if labelled else None), f"id {kinds[id_col]}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
