"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a block element gives a line, the edge of a container ends a run of lines, and
what stands in a menu, header, footer, sidebar, notice, advert, form or comment gives none. Each line has a
weight: its characters outside links up to LONG; in an article or main element LONG; and where a page has
such an element, lines outside it count OUTER of their characters, or nothing if the element has paragraphs. Weights
are summed over sliding windows of WINDOW lines of a run. Text surges at the first run whose windows reach a
threshold taken from the page and dives after the last one; all lines between are kept, but for runs of links. On
pages without such an element, short runs of paragraphs and headings next to these belong to them.

A name of a class removes nothing that holds all articles of the page, and a name that may stand for anything
(WEAK) nothing that holds a paragraph of HELD characters. A br ends a line, as an element of its own would.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: Characters a line counts as at most; share that counts of lines outside an article; share of a page's mean window that a run has to reach; share of links of a run of links.
LONG, OUTER, SHARE, LINKED = 240, 1 / 16, 1 / 16, 0.5
#: Characters outside links of a paragraph that a weak name doesn't remove.
HELD = 100
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset(["p", "blockquote", "pre"])

# Element names and the words of class, id and role that mark what isn't main text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside body div footer form head header main nav section table ul ol dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option button title".split())
DROPPED = RAW | frozenset("head nav footer aside form menu dialog fieldset label".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer comment comments commentlist cmt cmts respond replies disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay toolbar pagination pager "
    "complementary contentinfo skip".split()
)
# Marks that name a form rather than a content.
WEAK = frozenset("widget popup modal overlay panel".split())
OUTER_MARKS = MARKS | frozenset("header masthead topbar".split())
# Words that may stand beside a mark in one name.
BESIDE = frozenset(
    "site page main global primary secondary left right top bottom upper lower inner outer first last box bar block area section wrapper wrap container holder "
    "row col column panel list item items link links button buttons icon icons slot unit google body content text title heading label form field input article "
    "articles post posts story stories entry user users reader readers visitor visitors policy more read teaser tools count feed thread tree mobile desktop sticky fixed inline js".split()
)
IMPLIED_END = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marked(attributes: str, inner: bool) -> str:
    """"hidden", or "strong" or "weak" if one of its class, id and role names is made of marks and of words that stand beside them; else empty."""
    if not attributes.strip():
        return ""
    if _HIDDEN.search(attributes):
        return "hidden"
    found = ""
    marks = MARKS if inner else OUTER_MARKS
    for m in _MARKED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = {p.lower() for p in _PART.findall(name) if not p.isdigit()}
            if parts & marks and parts <= marks | BESIDE:
                if parts & marks - WEAK:
                    return "strong"
                found = "weak"
    return found


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    attributes: str
    empty: bool


def tags_of(page: str) -> tuple[list[Tag], dict[int, int]]:
    """The tags of a page, without what stands in raw elements, and of the start tags whose end is there the number of that end."""
    tags: list[Tag] = []
    ended: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    no_end: set[str] = set()
    at = 0
    while tag := _TOKEN.search(page, at):
        name, closing = (tag[2] or "").lower(), bool(tag[1])
        at, empty = tag.end(), tag[0].endswith("/>") or name in VOID
        if not closing and name in RAW and not empty:
            stop = None if name in no_end else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if stop or name in ("script", "style"):
                at = stop.end() if stop else len(page)
                name = ""
            else:
                no_end.add(name)
        tags.append(Tag(tag.start(), at, closing, name, tag[3] or "", empty))
        if closing and open_at.get(name):
            ended[open_at[name].pop()] = len(tags) - 1
        elif name and not closing and not empty:
            open_at.setdefault(name, []).append(len(tags) - 1)
    return tags, ended


class Line(NamedTuple):
    text: str
    inner: bool
    linked: int
    heading: bool
    paragraph: bool
    run: int


def _holds_text(page: str, tags: list[Tag], start: int, end: int) -> bool:
    """Whether a block between the tags start and end has HELD characters outside links."""
    size, in_link = 0, False
    for before, tag in zip(tags[start:end], tags[start + 1 : end + 1], strict=True):
        in_link = before.name == "a" and not before.closing or in_link and before.name != "a"
        size += 0 if in_link else len(" ".join(page[before.end : tag.start].split()))
        if size >= HELD:
            return True
        if tag.name in BLOCKS:
            size = 0
    return False


def lines_of(page: str) -> list[Line]:
    """The lines of a page in its order, with the number of the run each is in.

    Of an element that is to be dropped but has no end, the text up to the next block is dropped.
    """
    lines: list[Line] = []
    held: list[str] = []
    inner, at, run = 0, 0, 0
    in_link, linked, heading = False, 0, False
    dropped, nested, to_block = "", 0, False
    paragraph = False
    tags, ended = tags_of(page)
    articles = [i for i, t in enumerate(tags) if t.name in ("article", "main") and not t.closing]

    def close(edge: bool) -> None:
        nonlocal linked, run
        if text := " ".join(html.unescape("".join(held)).split()):
            lines.append(Line(text, inner > 0, min(linked, len(text)), heading, paragraph, run))
        held.clear()
        linked = 0
        run += edge

    for number, tag in enumerate([*tags, Tag(len(page), len(page), True, "", "", True)]):
        text = page[at : tag.start]
        if text and not dropped and not to_block:
            held.append(text)
            linked += len(" ".join(html.unescape(text).split())) * in_link
        at, name, closing = tag.end, tag.name, tag.closing
        if not name:
            continue
        if dropped:
            if dropped in IMPLIED_END and not closing and name in IMPLIED_END[dropped] or dropped == "p" and closing and name in CONTAINERS:
                dropped, nested = "", 0
            else:
                if name == dropped:
                    nested += -1 if closing else 1
                    dropped = dropped if nested else ""
                continue
        if name in BLOCKS:
            close(name in CONTAINERS)
            to_block = False
            heading = not closing and name in HEADINGS
            paragraph = paragraph if name == "br" else not closing and name in PARAGRAPHS
        if name == "a":
            in_link = not closing
        if not closing and not tag.empty and name not in ("html", "body", "main"):
            mark = "" if name in DROPPED else _marked(tag.attributes, inner > 0)
            if mark in ("strong", "weak") and number in ended:
                around = articles and number < articles[0] and articles[-1] < ended[number]
                if around or mark == "weak" and _holds_text(page, tags, number, ended[number]):
                    mark = ""
            if name in DROPPED or (name == "header" and not inner) or mark:
                close(True)
                if number in ended or name in IMPLIED_END:
                    dropped, nested = name, 1
                    continue
                to_block = True
        if name in ("article", "main"):
            inner = max(0, inner + (-1 if closing else 1))
    close(False)
    return lines


def main_text(page: str | None) -> str:
    """The lines between the first surge and the last dive of a page's weights, runs of links left out; null and empty pages have none."""
    lines = lines_of(page or "")
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines])
    inner = np.array([x.inner for x in lines])
    linked = np.array([x.linked for x in lines])
    edge = np.flatnonzero(np.diff([x.run for x in lines])) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(lines)]])
    of_links = (np.add.reduceat(linked, begin) > LINKED * np.add.reduceat(size, begin)) & ~np.logical_or.reduceat(inner, begin)
    if of_links.all():
        of_links[:] = False
    begin, end = begin[~of_links], end[~of_links]
    weight = np.minimum(size - linked / 2, LONG)
    paragraph = np.array([x.paragraph for x in lines])
    if inner.any():
        told = any(x.inner and x.paragraph and not x.heading for x in lines)
        weight = np.where(inner, LONG, 0 if told else weight * OUTER)
    # each line has the greatest of the windows that hold it
    window = np.zeros(len(lines))
    for a, b in zip(begin, end, strict=True):
        sums = np.convolve(weight[a:b], np.ones(WINDOW), "full")
        window[a:b] = np.lib.stride_tricks.sliding_window_view(sums, WINDOW).max(1)
    bound = SHARE * float(np.average(window, weights=weight * (window > 0)))
    dense = np.flatnonzero([window[a:b].max() >= bound for a, b in zip(begin, end, strict=True)])
    surge, dive = dense[0], dense[-1]
    near = paragraph if not inner.any() else np.array([x.heading for x in lines]) & (weight > 0)
    while surge and near[begin[surge - 1] : end[surge - 1]].all():
        surge -= 1
    while dive + 1 < len(begin) and not inner.any() and near[begin[dive + 1] : end[dive + 1]].all():
        dive += 1
    return "\n".join(x.text for a, b in zip(begin[surge : dive + 1], end[surge : dive + 1], strict=True) for x in lines[a:b])


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each page; null and empty pages have empty text.

    Repeated rows give repeated rows, an empty table an empty one. A column named like out is replaced.
    """
    rows = df.drop(out) if out != html_col else df
    names = rows.columns

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = pa.array([main_text(p) for p in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), texts], names=[*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit("")).schema)
