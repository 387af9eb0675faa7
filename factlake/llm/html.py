"""Main text of web pages by line-block distribution.

Markup is stripped, with the elements that are page furniture by their kind or name, and every other block
element's text becomes a line. A line weighs as much as it has text outside links. The weights are summed over
sliding windows of WINDOW lines, the blocks. Where a block first reaches SHARE of the page's own typical block
(the median of the blocks that have any text) the text surges, where the last such block ends it dives, and
all between is kept, short lines and lines of links too. Only windows without any text of their own, which are lists
of links outside marked articles, go. So blocks find the text on every page.

A block covers up to WINDOW - 1 lines beside the text, so an edge may be moved by fewer than WINDOW lines, and only there markup decides:
to the edge of a marked article, or else of the headings and paragraphs that the text is in; without either, lines lighter
than a block's share are left out.

Furniture is told by element (navigation, footers, forms, scripts, ...) and by the words of class, id and
role. Unclosed and crossed elements end where their parent ends; a page cut off in a tag ends there.

Defined results: a null or empty page, or one without text, gives the empty string and 0 characters; a page of
links only gives what an article of it holds, or else nothing; null page_id and url are kept; repeated rows each
get theirs; an empty table gives no rows; further columns are ignored. White space inside a block is one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, trimmed

BETWEEN = "\n\n"
#: lines of a block
WINDOW = 5
#: a block is text from this share of the page's typical block on
SHARE = 0.25

#: fixed values: elements by their part in a page
RAW = frozenset("script style template textarea title noscript iframe svg math canvas object xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside form button select menu dialog fieldset label head audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
#: fixed values: elements in which text is written
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p li blockquote pre dd dt caption figcaption address summary td".split())
#: fixed values: words of class, id and role that mark furniture
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments respond cookie cookies consent disclaimer "
    "disqus footer form gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert pagination pager popup promo "
    "promotion related recommended search share sharing sidebar sidenav social sponsor sponsored subscribe subscription toolbar topbar widget replies reply "
    "complementary contentinfo overlay paywall skip tags toc".split()
)
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?](?>[^>]*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>(?:[^>"']+|"[^"]*"|'[^']*'|["'])*))(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Line:
    __slots__ = ("parts", "chars", "linked", "furniture", "article", "tag")

    def __init__(self, furniture: bool, article: int, tag: str):
        self.parts: list[str] = []
        self.chars = self.linked = 0
        #: article: the number of the article that holds the line, from 1, or 0
        self.furniture, self.article, self.tag = furniture, article, tag

    @property
    def written(self) -> bool:
        return self.tag in HEADINGS or self.tag in PARAGRAPHS

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _marked(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for m in _MARKS.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role" and value.lower() == "form":
            return True
        if not FURNITURE_WORDS.isdisjoint(_WORD.findall(_CAMEL.sub(" ", value).lower())):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's lines, one for each stretch of text between block elements' edges."""
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements; True for those that are furniture
    state = {"furniture": 0, "article": 0, "link": 0, "articles": 0}
    line = Line(False, 0, "")

    def breaks() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        tag = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
        line = Line(state["furniture"] > 0, state["articles"] if state["article"] else 0, tag)

    def put(text: str) -> None:
        if text:
            line.parts.append(text)
            n = len("".join(text.split()))
            line.chars += n
            if state["link"]:
                line.linked += n

    def leave(to: int) -> None:
        while len(stack) > to:
            tag, furniture = stack.pop()
            state["furniture"] -= furniture
            state["article"] -= tag in ("article", "main")
            state["link"] -= tag == "a"

    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        put(unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                leave(depth)
            if tag in BLOCKS:
                breaks()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            put(" ")
            continue
        if tag in ("article", "main", "body") and not _marked(m[3]):
            # an element around the text ends furniture that was left open
            opened = next((i for i, (_, f) in enumerate(stack) if f), None)
            if opened is not None and (tag == "body" or all(t in ("head", "div", "span", "p", "ul", "li", "a") for t, _ in stack[opened:])):
                leave(opened)
        if tag in BLOCKS:
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "u", "small", "font") and any(t == "p" for t, _ in stack):
                leave(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "option") and stack and stack[-1][0] == tag:
                leave(len(stack) - 1)
        if tag not in VOID and not m[3].endswith("/"):
            furniture = tag in FURNITURE or (tag == "header" and not state["article"]) or _marked(m[3])
            if tag in ("body", "html", "article", "main") and not any(f for _, f in stack) and tag not in FURNITURE:
                furniture = tag == "article" and _marked(m[3])
            stack.append((tag, furniture))
            state["furniture"] += furniture
            if tag in ("article", "main"):
                state["articles"] += not state["article"]
                state["article"] += 1
            state["link"] += tag == "a"
        if tag in BLOCKS:
            breaks()
        elif tag in ("br", "td", "th", "img", "wbr"):
            put("" if tag == "wbr" else " ")
    rest = page[at:]
    put(unescape(rest))
    breaks()
    return out


def block_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """The sum of each run of `window` lines; of all lines, if they are fewer."""
    total = np.concatenate(([0], np.cumsum(weights)))
    window = min(window, len(weights))
    return total[window:] - total[: len(total) - window]


def covered(blocks: np.ndarray, n: int, window: int) -> np.ndarray:
    """By line, whether any of the blocks, True or False by first line, covers it."""
    window = min(window, n)
    change = np.zeros(n + 1, np.int64)
    change[: len(blocks)] += blocks
    change[window : window + len(blocks)] -= blocks
    return np.cumsum(change)[:n] > 0


def moved(lines: list[Line], weights: np.ndarray, edge: int, window: int, light: float, step: int) -> int:
    """The first (step 1) or last (step -1) line of the text, less than a window away from the line where blocks put it.

    Markup that lies within that reach decides: the edge of a marked article, or else of the headings and paragraphs that the text is in; else
    lines lighter than `light` are left out.
    """
    n = len(lines)
    reach = [i for i in range(edge - step * (window - 1), edge + step * window, step) if 0 <= i < n]  # from outside to inside
    article = lines[edge].article or next((lines[i].article for i in reach[reach.index(edge) :] if lines[i].article), 0)
    if article:
        return next(i for i in reach if lines[i].article == article)
    written = [lines[i].written for i in reach]
    at = reach.index(edge)
    text = [x and w > 0 for x, w in zip(written, weights[reach])]
    if 2 * sum(weights[i] for i, x in zip(reach[at:], written[at:]) if x) > sum(weights[i] for i in reach[at:]):
        at = text.index(True, at)
        while any(text[:at]) and written[at - 1]:  # lines of links stay only between lines of text
            at -= 1
        return reach[at]
    return next((i for i in reach[at:] if weights[i] >= light), edge)


def kept_lines(lines: list[Line], window: int = WINDOW, share: float = SHARE) -> list[Line]:
    """The lines of the main text, by the distribution of their blocks."""
    lines = [x for x in lines if x.chars and not x.furniture]
    weights = np.array([x.chars - x.linked for x in lines], np.int64)
    if not weights.any():
        return [x for x in lines if x.article]
    n, window = len(lines), min(window, len(lines))
    sums = block_sums(weights, window)
    least = max(1.0, share * float(np.median(sums[sums > 0])))
    surge, dive = np.flatnonzero(sums >= least)[[0, -1]]
    some = np.flatnonzero(weights)
    first, last = some[np.searchsorted(some, surge)], some[np.searchsorted(some, dive + window) - 1]
    first, last = moved(lines, weights, int(first), window, least / window, 1), moved(lines, weights, int(last), window, least / window, -1)
    links = covered(sums == 0, n, window)
    return [lines[i] for i in range(first, last + 1) if lines[i].article or not links[i]]


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    return BETWEEN.join(filter(None, (x.text() for x in kept_lines(lines_of(page or ""), window, share))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ready(pages.sparkSession)
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(scan, f"{kept}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
