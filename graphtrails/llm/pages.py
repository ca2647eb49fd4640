"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by the element they stand in, tags by their name: with
weights learned from labelled pages, words of content elements are positive, and tags negative or next to zero.
One linear scan finds the contiguous region with the highest sum; its blocks are the text. Labelled pages
are those that mark their content with ``<article>`` or ``<main>``; about ``MOST_PAGES`` of them at most (by a
hash) are counted, per kind of token, inside and outside of the mark. Elements that are never content
(scripts, styles, menus, forms, adverts, comments and the like, by tag, role, or a whole word of class or id) are out of
the region wherever they stand; so are articles inside of comments, asides and adverts.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one
``\\n``. Null and empty pages have empty text. Pages without positive tokens have none either. Markup that is
never closed ends with the page, at the latest where an article begins; a self-closing ``<svg/>`` or ``<math/>`` is
empty, and so are other self-closing elements without an end tag. Rows that repeat a ``page_id``
stay. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.words import bounded_batches, bounded_sample

#: Labelled pages that weights are counted on, at most.
MOST_PAGES = 2_000

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split())
MARKS = frozenset(["article", "main"])
# Elements, roles and words in classes or ids of what is no content.
NEVER = RAW | frozenset("head nav aside footer form button menu dialog canvas audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist disqus replies reply related recommended "
    "widget widgets toolbar pagination pager copyright legal disclaimer search form skip hidden "
    "site-header site-footer site-navigation main-navigation main-nav nav-menu main-menu cookie-banner cookie-notice cookie-consent "
    "comment-list comments-area comments-section comment-respond comment-form ad-banner ad-container ad-slot ad-wrapper adsbygoogle "
    "social-share share-buttons related-posts related-articles newsletter-signup widget-area skip-link".split())
# Of these, the comments and adverts, whose articles are not the page's; asides too.
HOLDING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus replies reply "
    "comment-list comments-area comments-section comment-respond comment-form ad-banner ad-container ad-slot ad-wrapper adsbygoogle".split())

_PIECE = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")


#: What an element is: content, none, or none and holding its articles back too.
CONTENT, NONE, HOLDER = 0, 1, 2


def _role(name: str, rest: str, inside: bool) -> int:
    role = CONTENT
    if name == "aside":
        return HOLDER
    if name in NEVER or name == "header" and not inside:  # an article's own header holds its title
        role = NONE
    if not rest or name in MARKS or name in ("html", "body", "header"):
        return role
    seen = set()
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:  # the first of a name counts
            continue
        seen.add(key)
        if key in ("class", "id"):
            words = value.split()
            if any(w in HOLDING for w in words):
                return HOLDER
            if any(w in NAMES for w in words):
                role = NONE
        elif key == "role" and value == "complementary":
            return HOLDER
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            role = NONE
    return role


def _is_empty(rest: str) -> bool:
    """Whether a tag closes itself: its slash is not the end of a value without quotes."""
    if not rest.endswith("/"):
        return False
    end = 0
    for found in _ATTRIBUTE.finditer(rest):
        end = found.end()
    return end < len(rest)


def _closed(page: str) -> set[int]:
    """Where the tags begin whose elements have an end tag of their own."""
    out, stack, at, no_end = set(), [], 0, set()
    while (found := _PIECE.match(page, at)) is not None:
        begin, at = at, found.end()
        name = (found["name"] or "").lower()
        if not name or name in VOID:
            continue
        if found["close"]:
            if any(x == name for x, _ in stack):
                while True:
                    last, place = stack.pop()
                    if last == name:
                        out.add(place)
                        break
        elif name in RAW:
            at = _after_raw(page, at, name, found["rest"], no_end)
        else:
            stack.append((name, begin))
    return out


def _after_raw(page: str, at: int, name: str, rest: str, no_end: set[str]) -> int:
    """The end of an element whose content is no markup; ``no_end`` are names known to have no further end tag."""
    empty = _is_empty(rest)
    if empty and name in ("svg", "math"):
        return at
    if name not in no_end:
        stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
        if stop:
            return stop.end()
        no_end.add(name)
    return at if empty else len(page)


def tokens(page: str) -> Iterator[tuple[str, str, int, bool]]:
    """``(kind, text, block, inside)`` in page order.

    The kind is ``#`` and the innermost element for text, or the tag's name; ``inside`` says whether a mark
    is open. Text and tags of elements that are never content don't come. Blocks are numbered.
    """
    stack: list[str] = []
    holders: list[tuple[int, int]] = []  # depth and place of open elements that hold their articles back
    closed: set[int] | None = None
    no_end: set[str] = set()
    block, never, marks = 0, 0, 0  # never: how many elements are open from the outermost one without content
    at, end = 0, len(page)
    while at < end:
        found = _PIECE.match(page, at)
        if found is None:
            return
        begin, at = at, found.end()
        text = found["text"]
        if text is not None:
            if not never:
                yield "#" + (stack[-1] if stack else ""), text, block, marks > 0
            continue
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            block += 1
        elif name == "br" and not never:
            yield "#br", " ", block, marks > 0
        if name in VOID:
            if not never:
                yield name, "", block, marks > 0
            continue
        if found["close"]:
            if name in stack:
                while True:
                    last = stack.pop()
                    never = never - 1 if never else 0
                    marks -= last in MARKS
                    if last == name:
                        break
                while holders and holders[-1][0] >= len(stack):
                    holders.pop()
                if not never:
                    yield name, "", block, marks > 0
            continue
        if name in RAW:  # their content is no markup
            at = _after_raw(page, at, name, found["rest"], no_end)
            continue
        if never and name in MARKS:
            if name == "article" and holders:
                closed = _closed(page) if closed is None else closed
                holders = [x for x in holders if x[1] in closed]
            if name == "main" or not holders:
                never, holders = 0, []
        if name == "p" and "p" in stack and not never:  # a paragraph ends where the next begins
            while stack.pop() != "p":
                pass
        elif name == "li" and "li" in stack and not never and stack[-1] not in ("ul", "ol", "menu"):
            while stack.pop() != "li":
                pass
        role = _role(name, found["rest"], marks > 0)
        if never:
            never += 1
        elif role:
            never = 1
        if role == HOLDER:
            holders.append((len(stack), begin))
        stack.append(name)
        marks += name in MARKS
        if not never:
            yield name, "", block, marks > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]
    for batch in batches:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for page in batch.column("html").to_pylist():
            items = list(tokens(page or ""))
            if not any(marked for _, _, _, marked in items):  # its only articles are no content
                continue
            for kind, text, _, marked in items:
                if kind != "#br":
                    (inside if marked else outside)[kind] += len(text.split()) if kind[:1] == "#" else 1
        both = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(both, pa.string()), pa.array([inside[k] for k in both], pa.int64()), pa.array([outside[k] for k in both], pa.int64())],
            schema=pa.schema(kinds))


#: Weights of kinds that no labelled page has: a word, and a tag.
UNSEEN_WORD, UNSEEN_TAG = 0.5, -0.25


def learn(pages: DataFrame, most: int = MOST_PAGES) -> dict[str, float]:
    """Weights of all kinds of tokens on ``most`` labelled pages at most, whose number of element names bounds them.

    A word's is the log odds of standing inside the mark; a tag's is at most -0.01, so that tags which
    only stand inside cost next to nothing.
    """
    bounded_batches(pages.sparkSession)
    labelled = pages.select("page_id", "html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = bounded_sample(labelled, "page_id", "html", most=most).select("html")
    counts = chosen.mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    weights = {}
    for kind, inside, outside in counts.collect():
        odds = math.log((inside + 0.5) / (outside + 0.5))
        weights[kind] = max(-4.0, min(4.0, odds)) if kind[:1] == "#" else min(-0.01, max(-4.0, odds / 4))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first and one past the last item of the contiguous part with the highest sum; empty if none is positive."""
    best, lo, hi = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str, weights: dict[str, float]) -> str:
    items = list(tokens(page))
    scores = []
    for kind, text, _, _ in items:
        if kind == "#br":
            scores.append(0.0)
        elif kind[:1] == "#":
            scores.append(weights.get(kind, UNSEEN_WORD) * len(text.split()))
        else:
            scores.append(weights.get(kind, UNSEEN_TAG))
    lo, hi = best_region(scores)
    blocks: list[list[str]] = []
    last = None
    for kind, text, block, _ in items[lo:hi]:
        if kind[:1] == "#":
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    clean = (_SPACE.sub(" ", references.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def _extract(weights: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return extract


def page_texts(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    weights = learn(pages, most)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")
