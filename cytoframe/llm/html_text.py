"""Main text of web pages by line-block distribution.

The markup is stripped into lines (one per block element). Lines of menus, page headers, footers,
forms, notices, adverts and comments stay in the sequence but weigh nothing, and neither do link
texts. The text lengths are summed over sliding windows of lines. From the heaviest window the
text surges backwards and dives forwards where a whole window weighs nothing; what lies between is
kept. Where the heaviest window stands in an ``article`` or ``main`` element, surge and dive go over the
lines of all such elements, and every line of one that has text weighs something: the edges of the
elements bound the text, short first and last paragraphs are not lost, nor are further articles. A
comment's own ``article`` is boilerplate, and so is all that a comments block holds up to its end tag. Names of
classes count as a whole, or in compounds with words of layout: ``ad-slot`` marks an advert, ``ad-vantages`` does not. A
list of links between two stretches of text in one container belongs to the text.

Defined cases: null or empty html, and a page with boilerplate only, give the empty text; markup
that is cut off or never closed is read as far as it goes, and a block of boilerplate without an end tag
ends at the next article or with the element around it; repeated rows give a row each; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^>]*(?:>|\Z))",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[-_:./]+|(?<=[a-z])(?=\d)")
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title"}
CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = set("head nav aside footer form button select dialog menu".split())
MAIN = {"article", "main"}
NEVER = MAIN | {"html", "body"}
#: names of a class, id or role that mark boilerplate wherever they stand
SURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr sidebar "
    "comments disqus navbar navigation breadcrumb breadcrumbs newsletter popup complementary contentinfo".split()
)
#: these may also be words about a paragraph, so inside an article they count only on a container that has no other name
MARKS = SURE | set(
    "banner notice notices widget comment respond menu nav footer share sharing social related subscribe modal login search".split()
)
#: a mark may stand with these in one name, such as ad-slot; with any other part the name is about something else
FRAME = set(
    "area bar block body bottom box btn btns button buttons card cell center col column container content desktop div form frame "
    "grid header holder icon icons inline inner item items label left link links list listing main mobile module number outer "
    "overlay page panel post posts prompt right row section sign signup site slot small stack strip sub text tile title "
    "tools top unit up wide wrap wrapper zone".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figure figcaption table ul ol dl em strong b i a".split())
CONTAINERS = set("div section td center dd details fieldset th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: code points of text on either side that make a list of links a part of it
HEAVY = 100
#: these mark boilerplate only outside the article, inside it they hold its headline
OUTER_MARKS = {"header", "masthead"}


CLASSES = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: an article of such a class is a reader's comment
COMMENT_CLASSES = {"comment", "comments", "comment-body", "comment-content", "comment-text"}


def _is_comment(name: str, attributes: str) -> bool:
    if name != "article" or "=" not in attributes:
        return False
    return any(COMMENT_CLASSES & set((m[1] or m[2] or m[3] or "").lower().split()) for m in CLASSES.finditer(attributes))


def _tags(html: str) -> tuple[list[tuple[re.Match, int]], list[int], list[bool], list[int]]:
    """All tags with the place where reading goes on; of each opened element the number of the tag that ends
    it, and whether that is its own end tag; numbers of the opened articles.

    An end tag closes the nearest open element of its name and ends all inside it; that of an inline element
    ends no block. What nothing ends, ends with the page.
    """
    tags: list[tuple[re.Match, int]] = []
    opened: list[tuple[int, str]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name
    blocks: list[int] = []
    stops: dict[int, int] = {}
    own: set[int] = set()
    mains: list[int] = []
    position = 0
    while tag := TAG.search(html, position):
        position, number, name = tag.end(), len(tags), (tag[2] or "").lower()
        if name in RAW and not tag[1] and not tag[3].endswith("/>"):
            end = CLOSERS[name].search(html, position)
            position = end.end() if end else len(html)
        elif not name or name in VOID or name in RAW:
            pass
        elif not tag[1]:
            places.setdefault(name, []).append(len(opened))
            if name in BLOCKS:
                blocks.append(len(opened))
            if name in MAIN:
                mains.append(number)
            opened.append((number, name))
        elif places.get(name) and (name in BLOCKS or not blocks or places[name][-1] > blocks[-1]):
            to = places[name][-1]
            own.add(opened[to][0])
            while len(opened) > to:
                inner, inner_name = opened.pop()
                stops[inner] = number
                places[inner_name].pop()
                if inner_name in BLOCKS:
                    blocks.pop()
        tags.append((tag, position))
    ends = [stops.get(n, len(tags)) for n in range(len(tags))]
    missing = {name: [] for name in places}
    for n, (tag, _) in enumerate(tags):
        name = (tag[2] or "").lower()
        if name not in missing or tag[1]:
            continue
        around = missing[name]
        while around and ends[around[-1]] < n:
            around.pop()
        if n not in own:
            around.append(n)
        elif around:
            # an element of its name around it has no end tag: if an article is inside, this end tag may be that one's
            at = bisect(mains, n)
            if at < len(mains) and mains[at] < ends[n]:
                own.discard(n)
    return tags, ends, [n in own for n in range(len(tags))], mains


@lru_cache(maxsize=10_000)
def _mark(name: str) -> str:
    """What one name of a class, id or role says: ``sure``, ``mark``, ``frame``, ``outer`` or nothing."""
    parts = [p for p in PART.split(name) if p and not p.isdigit()]
    if not parts or any(p not in MARKS and p not in FRAME and p not in OUTER_MARKS for p in parts):
        return ""
    if any(p in SURE for p in parts):
        return "sure"
    if any(p in MARKS for p in parts):
        return "mark"
    return "outer" if OUTER_MARKS & set(parts) else "frame"


def _is_boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not in_main):
        return True
    if name in NEVER or "=" not in attributes:
        return False
    for m in NAMES.finditer(attributes):
        said = [_mark(n) for n in (m[1] or m[2] or m[3] or "").lower().split()]
        if "sure" in said:
            return True
        if not in_main and ("mark" in said or "outer" in said):
            return True
        if in_main and name not in PROSE and "mark" in said and "" not in said:
            return True
    return False


def page_lines(html: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, weight, number of the article or main element or 0, number of its container or 0, is a heading) per line.

    Weight -1 marks boilerplate.
    """
    lines: list[tuple[str, int, int, int, bool]] = []
    containers: list[tuple[int, int]] = []
    parts: list[str] = []
    linked = position = mains = depth = inside = links = 0
    skipped = closed = heading = titled = False
    place = 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append((text, max(0, len(text) - linked), inside, place, titled))
        parts.clear()
        linked = 0

    tags, ends, own, _ = _tags(html)
    stop = 0
    for number, (tag, after) in enumerate([*tags, (None, len(html))]):
        text = html[position : tag.start() if tag else after]
        if text and not skipped:
            parts.append(text)
            linked += len(text) if links else 0
            if not text.isspace():
                place, titled = containers[-1][0] if containers else 0, heading
        position = after
        if not tag or not tag[2]:
            continue
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in RAW and not closing and not attributes.endswith("/>"):
            continue
        if skipped:
            # without an end tag of its own it ends before the article, or with the element around it
            early = not closed and name in NEVER and (closing or name in MAIN)
            if number < stop and not early:
                continue
            end_line()
            skipped = False
            if closed:
                continue
        if name in BLOCKS:
            end_line()
        while containers and containers[-1][1] <= number:
            containers.pop()
        if name in HEADINGS:
            heading = not closing
        if name == "a":
            links = 0 if closing else 1
        if name in MAIN and (closing or not _is_comment(name, attributes)):
            if closing:
                depth = max(0, depth - 1)
                inside = inside if depth else 0
            else:
                if not depth:
                    mains += 1
                    inside = mains
                depth += 1
        elif not closing and name not in VOID and (name in MAIN or _is_boilerplate(name, attributes, bool(depth))):
            end_line()
            if not lines or lines[-1][1] >= 0:  # a run of boilerplate is one break in the text
                lines.append(("", -1, inside, 0, False))
            skipped, stop, closed, links = True, ends[number], own[number], 0
        elif not closing and name in CONTAINERS:
            containers.append((number + 1, ends[number]))
    end_line()
    return lines


def _bridged(lines: list[tuple], weights: np.ndarray) -> np.ndarray:
    """Weights where lists of links inside a text weigh something.

    A run of lines that are links only is a part of the text if it stands in one container with what is before and after it: text of
    ``HEAVY`` code points on both sides, or a heading before.
    """
    weights = weights.copy()
    light = np.array([bool(t) and w == 0 for t, w, *_ in lines])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], light, [False]]).astype(int)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if a == 0 or b == len(lines):
            continue
        place = lines[a][3]
        if not place or any(line[3] != place for line in lines[a - 1 : b + 1]):
            continue
        before, after = a, b
        while before > 0 and weights[before - 1] > 0:
            before -= 1
        while after < len(lines) and weights[after] > 0:
            after += 1
        if weights[b:after].sum() >= HEAVY and (weights[before:a].sum() >= HEAVY or lines[a - 1][4]):
            weights[a:b] = 1
    return weights


def main_text(html: str, window: int = 3) -> str:
    """The text between the surge and the dive around the heaviest window of lines."""
    lines = page_lines(html)
    weights = np.array([max(0, w) for _, w, *_ in lines], dtype=np.int64)
    if not weights.any():
        kept = [t for t, _, inside, *_ in lines if t and inside]
        return "\n".join(kept)
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))[window - 1 :]
    peak = int(sums.argmax())
    peak += int(weights[peak : peak + window].argmax())
    if lines[peak][2]:
        # over the lines of all articles; each of one that has text weighs something
        full = {inside for _, w, inside, *_ in lines if w > 0}
        lines, peak = [line for line in lines if line[2]], sum(bool(line[2]) for line in lines[:peak])
        lines = [(t, max(0, w), inside) for t, w, inside, *_ in lines]
        weights = np.array([w or inside in full for _, w, inside in lines], dtype=np.int64)
    else:
        weights = _bridged(lines, weights)
    start, end = peak, peak + 1
    while start > 0 and weights[max(0, start - window) : start].any():
        start -= 1
    while end < len(lines) and weights[end : end + window].any():
        end += 1
    return "\n".join(line[0] for line in lines[start:end] if line[0] and line[1] >= 0)


def _extracted(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            texts = [main_text(h, window) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"]
            )


def extract_main_text(pages: DataFrame, window: int = 3, key: str = "page_id") -> DataFrame:
    """``key``, ``url`` and ``text`` of every page; a page is read on its own, without a shuffle."""
    rows = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    out = arrow(rows, lambda batches: _extracted(batches, window), f"key {kind}, url string, text string")
    return out.withColumnRenamed("key", key)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
