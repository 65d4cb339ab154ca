"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser become lines, one for each block of text. The
text-to-tag ratios of a page's lines are smoothed by a Gaussian, and those above one standard
deviation are content. The element that holds this content is the region whose blocks make the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import small_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split())
#: Elements that can be the region of the main text.
_REGION = frozenset("article main section div body td center html".split())
_SKIPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg canvas button select textarea dialog"
    " menu head title audio video map search".split())
#: Words in ``class``, ``id`` or ``role`` that mark what is not main text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar"
    " sidebars aside widget related recommended recommendations comment comments disqus respond replies menu nav navbar"
    " navigation breadcrumb breadcrumbs header masthead footer copyright login search pagination pager toolbar skip hidden"
    " contentinfo complementary teaser teasers form outbrain taboola".split())
#: Marks count on these only as roles: sites put layout words on them.
_EXEMPT = frozenset(("html", "body", "main", "article"))
_CONTENT = frozenset("content article post entry story main articlebody".split())
_WORD = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Lines (text parts, tags, anchor characters, path) of a page; a path is the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, bool]] = []  # tag, and whether it is named as content
        self.stack: list[tuple[str, int, bool]] = []  # tag, element, skipped
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, tuple(e for _, e, _ in self.stack)))
        if text or not self.parts:
            self.tags = 0
        self.parts, self.linked = [], 0

    def _skipped(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def _pop_to(self, at: int) -> None:
        self.anchors = max(0, self.anchors - sum(t == "a" for t, _, _ in self.stack[at:]))
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
            # an open paragraph ends where a block begins
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == "p":
                    self._pop_to(at)
                    break
                if self.stack[at][0] in _REGION or self.stack[at][0] in _SKIPPED:
                    break
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        marks, roles, hidden = set(), set(), False
        for name, value in attrs:
            if name in ("class", "id", "itemprop"):
                marks.update(_WORD.findall((value or "").lower()))
            elif name == "role":
                roles.update(_WORD.findall((value or "").lower()))
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value or ""):
                hidden = True
        skipped = self._skipped() or hidden or tag in _SKIPPED or bool(roles & _MARKS) or (
            tag not in _EXEMPT and bool(marks & _MARKS))
        self.elements.append((tag, tag in ("article", "main") or "main" in roles or bool(marks & _CONTENT)))
        self.stack.append((tag, len(self.elements) - 1, skipped))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash does not close other elements
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop_to(at)
                return
            if tag not in _BLOCK and self.stack[at][0] in _BLOCK:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data):
        if not self._skipped():
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _smoothed(values: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + radius], values[i + k]) for k in range(-radius, radius + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_lines(lines: list[tuple[str, int, int, tuple[int, ...]]]) -> list[bool]:
    """Which lines are content: smoothed text-to-tag ratio at least its standard deviation over the page."""
    ratios = _smoothed([len(text) / max(1, tags) for text, tags, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= min(deviation, max(ratios)) for r in ratios]


def main_text(html: str) -> str:
    """The blocks of a page's main text, joined by blank lines; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    content = content_lines(lines)
    weight: Counter[int] = Counter()
    for (text, _, _, path), good in zip(lines, content, strict=True):
        if good:
            weight.update(dict.fromkeys(path, len(text)))
    total = sum(len(text) for (text, *_), good in zip(lines, content, strict=True) if good)
    named = [e for e, n in weight.items() if parser.elements[e][1] and parser.elements[e][0] in _REGION and 2 * n >= total]
    if named:
        best = max(weight[e] for e in named)
        # an article that holds nearly all of it is left only for what has no other article beside it
        articles = [e for e in named if parser.elements[e][0] == "article" and 10 * weight[e] >= 9 * best]
        if articles:
            article = min(articles)
            around = next(path[:path.index(article)] for *_, path in lines if article in path)
            others = {e for *_, path in lines if article not in path and any(parser.elements[x][0] == "article" for x in path) for e in path}
            region = min([article, *(e for e in named if e in around and e not in others)])
        else:
            region = min(e for e in named if weight[e] == best)
        return "\n\n".join(text for text, _, _, path in lines if region in path)
    # else down from the root while one child region holds nearly all of it
    region = -1
    for e in sorted(weight):
        if parser.elements[e][0] in _REGION and 10 * weight[e] >= 9 * total:
            region = e
    down = next((path[:path.index(region) + 1] for *_, path in lines if region in path), ())
    inside = [i for i, line in enumerate(lines) if region < 0 or region in line[3]]
    good = {i for i in inside if content[i]}
    return "\n\n".join(
        text for i, (text, _, linked, path) in enumerate(lines)
        if i in good or 2 * linked <= len(text) and (region < 0 or region in path or _beside(path, down, parser.elements)))


def _beside(path: tuple[int, ...], down: tuple[int, ...], elements: list[tuple[str, bool]]) -> bool:
    """Whether a line is a heading, or a block right below one of the elements ``down`` that lead to the region, and not in a region of its own."""
    common = 0
    while common < min(len(path), len(down)) and path[common] == down[common]:
        common += 1
    tags = [elements[e][0] for e in path[common:]]
    return not any(t in _REGION for t in tags) or tags[0] in _REGION and not any(t in _BLOCK for t in tags[1:]) or any(t in _HEADING for t in tags)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of each page.

    Left out are menus, headers, footers, asides, forms, scripts, hidden parts, and elements whose class, id or
    role names them as adverts, notices, sidebars, comments and the like. Inside a block white space is
    one space; blocks are joined by a blank line. Null and empty pages, and pages without main text,
    give an empty text. One row for each input row, ids and urls (null too) as they are; further
    columns are not used. A page is parsed as a whole, however long.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(html or "") for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])
    return rows.mapInArrow(run, "id long, url string, text string")
