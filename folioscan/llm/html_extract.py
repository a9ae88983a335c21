"""Main text of web pages as the maximum-scoring subsequence of words and tags.

Labelled pages teach a log-odds for every feature of the place that a word stands in: the sectioning tags and the class
and id names of the elements around it. A word scores by the nearest element with evidence, or an aside around that, at
most one unit either way. Where neither tags nor names tell anything, a logistic model of its block does, fitted to such
blocks of the labelled pages: the block's tag, length, share of links, depth, the blocks before and after it, and whether
it stands in an article, outside of those of its page, or on a page without one. What an article leaves outside is thus
judged like anything else: no tag rules out text. A tag costs what tags cost in the labelled pages. One linear scan finds
the contiguous region of the highest sum. Words of the region that score below zero, in a menu inside an article for
instance, are left out. Where nothing scores above zero, a page's text outside of asides and lists of links is kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm.common import table
from folioscan.llm.html_labels import labelled_pages

#: Elements whose content is no text of the page, or is raw. Fixed values.
DROPPED = frozenset("script style noscript template iframe canvas audio video textarea select option datalist button head title".split())
RAW = ("script", "style", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of text. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that tell by themselves what their text is. Fixed values.
SECTIONS = frozenset("article main nav aside header footer form menu dialog fieldset label".split())
#: Elements whose names tell by any part what they hold; elsewhere a name tells by the whole of it only, and is learned apart. Fixed values.
CONTAINERS = frozenset("html body div section article main aside nav header footer form table tbody tr td ul ol dl menu dialog fieldset figure details".split())
#: What an element of the key closes when it begins, up to the nearest element of the set. Fixed values.
CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_P_ENDS = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|data-main|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _features(tag: str, attributes: str) -> tuple[tuple[tuple[str, ...], ...], bool | None]:
    """Features of an element, those of one name together, and whether it is labelled as main, or as not so."""
    found, main = [(f"<{tag}",)] if tag in SECTIONS else [], None
    if attributes and not attributes.isspace():
        for name, a, b, c in _NAMES.findall(attributes):
            value = a or b or c
            if name.lower() == "data-main":
                main = value != "no"
            elif name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
                found.append(("<hidden",))
            elif name.lower() in ("class", "id"):
                names = [tuple(x.lower() for x in _PART.findall(one)) for one in value.split()]
                found += [x if tag in CONTAINERS else (f".{x[0]}",) for x in names if x and (tag in CONTAINERS or len(x) == 1)]
    return tuple(found), main


class _Place:
    """An open element: the evidence of its tag and of its names and, once the page was read, its words, those of them in articles, and its score."""

    __slots__ = ("around", "block", "by_name", "by_tag", "depth", "dropped", "inner", "inside", "link", "main", "score", "tag", "trail", "words")

    def __init__(self, tag: str, features: tuple[tuple[str, ...], ...], main: bool | None, around: "_Place | None", weights: dict[str, float] | None):  # noqa: UP037
        self.tag, self.around, self.main = tag, around, bool(around and around.main) if main is None else main
        self.block = tag if tag in BLOCKS or around is None else around.block
        self.depth, self.link = around.depth + (tag not in ("html", "body")) if around else 0, tag == "a" or bool(around and around.link)
        self.dropped = tag in DROPPED or bool(around and around.dropped)
        self.trail = (around.trail if around else ()) + tuple(f for name in features for f in name) if weights is None else ()
        self.inner = tag in ("article", "main") or bool(around and around.inner)
        self.words, self.inside, self.score = -1, 0, 0.0
        scored = [(name[0].startswith("<"), min(e) if min(e) < 0 else max(e)) for name in features if (e := [weights[f] for f in name if f in weights])] if weights else []
        tags, names = [e for is_tag, e in scored if is_tag], [e for is_tag, e in scored if not is_tag]
        self.by_tag, self.by_name = min(tags) if tags and min(tags) < 0 else max(tags, default=0.0), max(names, default=0.0)

    @property
    def outermost(self) -> bool:
        """Whether it is an article or main element within no other."""
        return self.tag in ("article", "main") and not self.around.inner

    def one_of_many(self, page: "_Place") -> bool:  # noqa: UP037
        """Whether it is one of several articles of the page, and none that holds most of their words: cards and comments are articles, too."""
        return self.outermost and 2 * self.words <= page.inside

    def evidence(self, page: "_Place") -> float:  # noqa: UP037
        by_tag = 0.0 if self.one_of_many(page) else self.by_tag
        # a nav is one by any name; "post with-sidebar" is no sidebar, but "comment-body" is a comment's
        own = by_tag if by_tag < 0 else self.by_name or by_tag
        if self.tag == "header" and self.around.inner:
            own = 0.0  # of the article, not of the page
        if self.inside and self.inside == page.inside and 2 * self.words >= page.words:
            own = max(own, 0.0)  # all articles and most words: the page's layout, whatever its names say
        if self.inside and 2 * self.inside >= self.words:
            own = min(own, 0.0)  # its names mean the article, and nothing for what stands beside it
        return own

    def settle(self, page: "_Place") -> None:  # noqa: UP037
        """Its score, once that of the element around it is known: an aside stays one whatever it holds; otherwise the nearest evidence counts."""
        before = 0.0 if self.tag == "main" and self.outermost else self.around.score
        self.score = before if before < 0 and self.around.tag not in ("html", "body") else self.evidence(page) or before


def read_page(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, _Place | None, int]]:
    """The tokens of a whole page, their places with scores."""
    runs = list(tokens(page, weights))
    order: list[_Place] = []  # those around others come before them
    for text, place, _ in runs:
        chain, p = [], place
        while p is not None and p.words < 0:
            p.words = 0
            chain.append(p)
            p = p.around
        order += reversed(chain)
        if place is not None:
            place.words += len(text.split())
    for p in reversed(order[1:]):
        p.around.words += p.words
        p.around.inside += p.words if p.outermost else p.inside
    for p in order[1:]:
        p.settle(order[0])
    return runs


def tokens(page: str, weights: dict[str, float] | None = None) -> Iterator[tuple[str, _Place | None, int]]:
    """(text, place, block) of each run of text and ("", None, block) of each tag, in page order; dropped content is passed over."""
    root = _Place("html", (), None, None, weights)
    stack, at, block, low = [root], 0, 0, None
    where: dict[str, list[int]] = {}  # the open elements of each tag, and those that begin a block, as places in the stack
    blocks: list[int] = []

    def close(place: int) -> None:
        while len(stack) > place:
            gone = stack.pop().tag
            where[gone].pop()
            if gone in BLOCKS:
                blocks.pop()

    while at < len(page):
        m = _MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not stack[-1].dropped:
            if "<" in text:
                text = re.sub(r"<[/a-zA-Z!?].*\Z", "", text, flags=re.S)
            yield html.unescape(text), stack[-1], block
        if not m:
            return
        at = m.end()
        if m[1] is not None:
            if not stack[-1].dropped:
                yield m[1], stack[-1], block
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or ""
        if tag in BLOCKS:
            block += 1
        if tag == "br" and not stack[-1].dropped:
            yield " ", stack[-1], block
        yield "", None, block
        if closing:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in VOID or attributes.endswith("/") and (where.get("svg") or where.get("math")):  # elsewhere a slash at the end means nothing
            continue
        if tag in CLOSES:
            ends, upto = CLOSES[tag]
            nearest = max((where[t][-1] for t in {*ends.split(), *upto} if where.get(t)), default=0)
            if nearest and stack[nearest].tag in ends.split():
                close(nearest)
        if tag in _P_ENDS and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in ("html", "body"):
            features, main = _features(tag, "")
        else:
            features, main = _features(tag, attributes)
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(_Place(tag, features, main, stack[-1], weights))
        if tag in RAW:
            if low is None:
                low = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end


def _root(runs: list[tuple[str, _Place | None, int]]) -> _Place | None:
    """The place around all others, if there is any text."""
    place = next((p for _, p, _ in runs if p is not None), None)
    while place is not None and place.around is not None:
        place = place.around
    return place


#: Kinds of blocks by tag, the bounds of their buckets of words, depths and shares of links, and how many features a block has.
_KINDS = {t: i for i, tags in enumerate(("p", "li dt dd", "h1 h2 h3 h4 h5 h6", "td th", "pre blockquote figcaption")) for t in tags.split()}
_LENGTHS, _DEPTHS, _SHARES = (3, 6, 11, 21, 41), (2, 5, 9), (1e-9, 0.34, 0.67)
_WIDTH = 6 + 24 + 4 + 2 * 25 + 3 * 6


def block_features(runs: list[tuple[str, _Place | None, int]]) -> dict[int, list[int]]:
    """The features, of _WIDTH, that each block with words has: its kind, its length and share of links, its depth, those of its neighbours, and by length whether it is in an article, outside of those of its page, or on a page without."""
    words: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    place_of: dict[int, _Place] = {}
    for text, place, block in runs:
        if place is not None and (n := len(text.split())):
            words[block] += n
            linked[block] += n * place.link
            place_of.setdefault(block, place)
    order = sorted(words)
    shape = [4 * bisect_right(_LENGTHS, words[b]) + bisect_right(_SHARES, linked[b] / words[b]) for b in order]
    around = [24, *shape, 24]
    articles = any(p.inner for p in place_of.values())
    side = lambda b: 84 + 6 * ((2 if place_of[b].inner else 1) if articles else 0) + bisect_right(_LENGTHS, words[b])
    return {b: [_KINDS.get(place_of[b].block, 5), 6 + shape[i], 30 + bisect_right(_DEPTHS, place_of[b].depth), 34 + around[i], 59 + around[i + 2], side(b)] for i, b in enumerate(order)}


@dataclass
class Model:
    """Log-odds of main text for each tag and name, weights of a block's features and their bias, and the cost of a tag."""

    odds: dict[str, float]
    blocks: np.ndarray
    cost: float


def _fit_blocks(rows: list[list[int]], main: list[bool]) -> np.ndarray:
    """Weights and, last, the bias of a logistic model, by Newton's method with a ridge."""
    x, y = np.zeros((len(rows), _WIDTH + 1)), np.array(main, dtype=float)
    for i, r in enumerate(rows):
        x[i, [*r, _WIDTH]] = 1
    w = np.zeros(_WIDTH + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(_WIDTH + 1), x.T @ (y - p) - w)
    return w


#: Seed and number of the labelled pages that are learned from, least number of them that a name must be on, and least log-odds.
PAGES, LEAST_PAGES, TELLING = (1, 400), 3, 0.7


@lru_cache(maxsize=1)
def learned() -> Model:
    pages = labelled_pages(*PAGES)
    main, rest, on, tags, words = Counter(), Counter(), Counter(), 0, 0
    inside = outside = 0
    for page in pages:
        seen: set[str] = set()
        runs = read_page(page)
        top = _root(runs)
        for text, place, _ in runs:
            if place is None:
                tags += 1
                continue
            n = len(text.split())
            words += n * place.main
            article = place
            while article.inner and not article.outermost:
                article = article.around
            features = {*place.trail} - ({"<article", "<main"} if article.inner and article.one_of_many(top) else set())
            seen |= features
            (main if place.main else rest).update(dict.fromkeys(features, n))
            inside, outside = inside + n * place.main, outside + n * (not place.main)
        on.update(seen)
    odds = {f: float(np.log(((main[f] + 0.5) / (inside + 1)) / ((rest[f] + 0.5) / (outside + 1)))) for f in main | rest if on[f] >= LEAST_PAGES}
    odds = {f: o for f, o in odds.items() if abs(o) > TELLING and f not in ("<html", "<body")}
    odds = {f: o for f, o in odds.items() if o < 0 or not f.startswith(".")}  # a paragraph's name can tell that it's none of the text, but hardly that it is
    rows, labels = [], []
    for page in pages:
        runs = read_page(page, odds)
        known = {b: p for _, p, b in reversed(runs) if p is not None}
        for b, features in block_features(runs).items():
            if not known[b].score:
                rows.append(features)
                labels.append(known[b].main)
    return Model(odds, _fit_blocks(rows, labels), words / tags / 100)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region (start, end) of the greatest sum, the first and shortest of equals; (0, 0) if none is above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def kept_runs(page: str, model: Model) -> list[tuple[str, int]]:
    """(text, block) of the runs of main text, in page order."""
    runs = read_page(page, model.odds)
    of_block = {b: float(model.blocks[f].sum() + model.blocks[-1]) / 2 for b, f in block_features(runs).items()}
    scores, kept = [], []
    for text, place, block in runs:
        if place is None:
            scores.append(-model.cost)
            kept.append(False)
            continue
        n, unit = len(text.split()), max(-1.0, min(1.0, place.score or of_block.get(block, 0.0)))
        # what is left out costs little inside a region, so that a menu in it doesn't part an article
        scores.append(n * unit if unit > 0 else n * unit * (0.05 if place.inner else 0.5))
        kept.append(unit > 0)
    start, end = best_region(scores)
    found = [(text, block) for (text, _, block), keep in zip(runs[start:end], kept[start:end], strict=True) if keep and text]
    return found or _outside_asides(runs)


def _outside_asides(runs: list[tuple[str, _Place | None, int]]) -> list[tuple[str, int]]:
    """(text, block) of what has no evidence against it, but for blocks that are links for the most part."""
    links: Counter[int] = Counter()
    for text, place, block in runs:
        if place is not None:
            links[block] += len(text.split()) * (1 if place.link else -1)
    return [(text, block) for text, place, block in runs if place is not None and place.score >= 0 and links[block] <= 0 and text]


def main_text(page: str | None, model: Model | None = None) -> str:
    """The main text of a page: blocks joined by line ends, white space inside a block by one space; empty if there is none."""
    blocks: dict[int, list[str]] = {}
    for text, block in kept_runs(page, model or learned()) if page else ():
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def page_score(pages: list[str], model: Model | None = None) -> float:
    """The F1 score, by words, of the text found on labelled pages."""
    both = found = wanted = 0
    for page in pages:
        want = Counter(w for text, place, _ in tokens(page) if place is not None and place.main for w in text.split())
        got = Counter(w for text, _ in kept_runs(page, model or learned()) for w in text.split())
        both, found, wanted = both + (want & got).total(), found + got.total(), wanted + want.total()
    return 2 * both / max(1, found + wanted)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with their main text. Null and empty pages, and pages of asides and links only, have the empty text; every row,
    repeated ones too, and every other column stays, but for one of the name out_col. An empty table stays empty."""
    sent = pages.sparkSession.sparkContext.broadcast(learned())  # a few hundred weights

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda page: main_text(page, sent.value), na_action=None).astype(object)

    return pages.withColumn(out_col, run(F.col(html_col)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
