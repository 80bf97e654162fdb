"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each at the leaf of a tag path (block-level tags with their first class
name). Text length, linked text and punctuation are aggregated per path; the ratio per path is
smoothed over the page's order of blocks, fused with the path's own ratio, and thresholded. The
innermost element that holds all paths over the threshold, or the article or main around them, is
the content, and its blocks are returned whole; out of an article, linked lists are not.

What an element's tag or names say is one factor of its paths' ratios: in an article they count
more; in a menu, footer, advert and the like less, so that a path in one of these, below the
content's own element, must be over the threshold by its ratio to stay. No name decides alone.

The scanner passes over a page once: elements are numbered, paths are interned, and open elements
are looked up by tag, so a page of any length or depth takes time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import small_batches

# HTML's element classes and the names that pages give to what is not their article.
RAW = frozenset("script style noscript template textarea iframe svg title object select math canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article main section div td body html blockquote".split())
ARTICLES = frozenset("article main".split())
ITEMS = frozenset("li dt dd tr td th".split())
BREAKS = frozenset("br hr img wbr".split())
ASIDE = frozenset("nav footer aside button dialog menu fieldset label".split())
STRONG = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond reply replies disqus pagination pager popup modal copyright skip notice notices complementary contentinfo".split())
WEAK = frozenset("header masthead topbar top banner widget widgets search alert legal toolbar tools meta tags form disclaimer message".split())
CONTENT = frozenset("article content main post entry story body text".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:all |our |latest |recent |reader |readers.? |user |visitor )?(?:comments?(?: section)?|kommentare?|commentaires?|comentarios?|commenti|reacties)(?:\W+\d+)?\W*", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTE = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
HUGE = re.compile(r"&#0*[0-9]{8,};?")  # no character has so high a number

KERNEL = np.array([1.0, 2.0, 4.0, 2.0, 1.0]) / 10
THRESHOLD = 0.35
ARTICLE_WEIGHT = 64.0
ASIDE_WEIGHT = 0.01
WEAK_WEIGHT = 0.1
LEAST_WEIGHT = 1e-9


@dataclass
class Page:
    """A page's elements (lists by number, parents first) and blocks (text, element, linked characters)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    section: list[int] = field(default_factory=lambda: [0])  # the innermost sectioning element
    article: list[int] = field(default_factory=lambda: [-1])  # the outermost article or main
    weight: list[float] = field(default_factory=lambda: [1.0])
    slights: list[int] = field(default_factory=lambda: [0])  # elements down to it whose factor is below 1
    aside: list[bool] = field(default_factory=lambda: [False])  # in an element that HTML sets apart from content
    title: list[bool] = field(default_factory=lambda: [False])
    hidden: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[str, int, int]] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)


def _names(attributes: str) -> tuple[str, bool, bool, bool]:
    """The first class name; whether the element is hidden, and by its names surely or perhaps no content."""
    label, hidden, strong, weak, content = "", False, False, False, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if name == "class":
                label = label or (value.split() or [""])[0]
            strong |= not STRONG.isdisjoint(words)
            weak |= not WEAK.isdisjoint(words)
            content |= not CONTENT.isdisjoint(words)
    return label, hidden, strong, weak and not content


def _tokens(page: str):
    """(text or None, tag, whether it closes, attributes) in order: scripts, comments and tags that
    the page's end cuts off are left out. A tag ends at the first > out of quoted values; if such a
    value is never closed, from there on at the first >."""
    at, quotes, last = 0, True, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        head = page[lt + 1 : lt + 2]
        closes = head == "/"
        name = NAME.match(page, lt + 1 + closes)
        if not name:
            if not head or head not in "!?/":
                yield "<", "", False, ""
                at = lt + 1
                continue
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment and not page.startswith((">", "->"), lt + 4) else page.find(">", lt)
            if end < 0:
                return
            at = end + (3 if page[end] == "-" else 1)
            continue
        end = page.find(">", name.end())
        if end < 0:
            return
        place = name.end()
        while quotes and not closes:
            q = QUOTE.search(page, place)
            if q is None or q[0] == ">":
                end = q.start() if q else end
                break
            place = page.find(q[0][-1], q.end()) + 1
            quotes = 0 < place <= last
        at, tag = end + 1, name[0].lower()
        if tag in RAW and not closes:
            over = RAW_END[tag].search(page, at)
            end = page.find(">", over.end()) if over else -1
            if tag not in ("svg", "math", "iframe", "object", "canvas") or page[at - 2] != "/":
                at = end + 1 if end >= 0 else len(page)
            yield None, "", False, ""
            continue
        yield None, tag, closes, page[name.end() : end]


def scan(page: str) -> Page:
    """The elements and blocks of a page."""
    out = Page()
    tags, numbers = [""], [0]  # open elements
    opened: dict[str, list[int]] = defaultdict(list)  # by tag: their places in the stack
    sections, blocks = [0], [0]  # places of open sectioning and block elements
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", html.unescape(HUGE.sub("\ufffd", "".join(text)))).strip()
            if whole:
                out.blocks.append((whole, numbers[-1], min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(place: int) -> None:
        while len(tags) > place:
            opened[tags.pop()].pop()
            numbers.pop()
        while sections[-1] >= place:
            sections.pop()
        while blocks[-1] >= place:
            blocks.pop()

    for words, tag, closes, attributes in _tokens(page):
        if words is not None:
            text.append(words)
            if opened["a"]:
                linked += len(words)
            continue
        if tag in BREAKS:
            text.append(" ")
        if tag in BLOCKS:
            flush()
        if closes:
            place = opened[tag][-1] if opened[tag] else 0
            if place and (tag in BLOCKS or sections[-1] < place):
                close(place)
            continue
        if tag in EMPTY or not tag:
            continue
        while tag in BLOCKS and blocks[-1] and (tags[blocks[-1]] == "p" or tag in ITEMS and tags[blocks[-1]] == tag):
            close(blocks[-1])  # an open paragraph, and an item of the same list, end where a block begins
        up, label, hidden, strong, weak = numbers[-1], "", False, False, False
        if attributes and not attributes.isspace():
            label, hidden, strong, weak = _names(attributes)
        article = out.article[up] >= 0
        factor = 1.0
        if tag in ARTICLES and not article:
            factor = ARTICLE_WEIGHT
        if tag in ASIDE or strong or tag == "header" and not article:
            factor *= ASIDE_WEIGHT
        elif tag == "form" or weak and not article:
            factor *= WEAK_WEIGHT
        number = len(out.parent)
        out.parent.append(up)
        out.tag.append(tag)
        out.path.append(out.paths.setdefault((out.path[up], f"{tag}.{label}"), len(out.paths) + 1) if tag in BLOCKS else out.path[up])
        out.section.append(number if tag in SECTIONS else out.section[up])
        out.article.append(number if tag in ARTICLES and not article else out.article[up])
        out.weight.append(max(out.weight[up] * factor, LEAST_WEIGHT))
        out.slights.append(out.slights[up] + (factor < 1))
        out.aside.append(out.aside[up] or tag in ASIDE)
        out.title.append(tag == "h1" or out.title[up] and tag not in BLOCKS)
        out.hidden.append(out.hidden[up] or tag == "head" or hidden and tag not in ("html", "body"))
        if tag in SECTIONS:
            sections.append(len(tags))
        if tag in BLOCKS:
            blocks.append(len(tags))
        opened[tag].append(len(tags))
        tags.append(tag)
        numbers.append(number)
    flush()
    return out


def ratios(page: Page) -> tuple[dict[int, float], dict[int, float]]:
    """Fused ratio, and share of linked text, of each path with blocks."""
    length, marks, links, many, weight = (defaultdict(float) for _ in range(5))
    for text, e, linked in page.blocks:
        p = page.path[e]
        length[p] += len(text)
        marks[p] += len(PUNCTUATION.findall(text))
        links[p] += linked
        many[p] += 1
        weight[p] += page.weight[e]
    ratio = {p: length[p] / n * (1 + marks[p] / n) * (1 - links[p] / length[p]) * weight[p] / n for p, n in many.items()}
    order = [page.path[e] for _, e, _ in page.blocks]
    smooth = np.convolve([ratio[p] for p in order], KERNEL)[2:-2]
    near: dict[int, float] = defaultdict(float)
    for p, s in zip(order, smooth.tolist(), strict=True):
        near[p] += s
    return {p: float(np.sqrt(r * near[p] / many[p])) for p, r in ratio.items()}, {p: links[p] / length[p] for p in many}


def _regions(page: Page, chosen: set[int]) -> dict[int, int]:
    """The elements whose blocks are content, with their slights: the outermost article or main
    around chosen sections; without any, the innermost element around all of them."""
    if any(page.article[e] >= 0 for e in chosen):
        found = {page.article[e] if page.article[e] >= 0 else e for e in chosen}
    else:
        inside = np.zeros(len(page.parent), np.int64)
        inside[list(chosen)] = 1
        inside = inside.tolist()
        for e in range(len(inside) - 1, 0, -1):
            inside[page.parent[e]] += inside[e]
        found = {max(e for e, n in enumerate(inside) if n == len(chosen))}
    return {e: page.slights[e] for e in found}


def _comments(page: Page) -> set[int]:
    """The blocks of reader comments that only their heading tells, with that heading.

    A section or div, but no article or main, that begins with such a heading holds comments. Elsewhere
    what follows it in the same element does, up to a heading of its rank, if it comes in elements of
    its own: paragraphs side by side with the heading are the article's.
    """
    out: set[int] = set()
    for i, (text, e, _) in enumerate(page.blocks):
        while page.tag[e] not in HEADINGS and page.tag[e] not in BLOCKS and page.parent[e] >= 0:
            e = page.parent[e]
        rank = HEADINGS.get(page.tag[e], 0)
        if rank < 2 or len(text) > 60 or not COMMENTS.fullmatch(text):
            continue
        around = page.parent[e]
        while around > 0 and page.tag[around] in ("header", "hgroup"):
            around = page.parent[around]

        below: dict[int, int] = {around: -1, -1: -1}  # of an element, the one just below around that it is in

        def inner(e: int, around: int = around, below: dict[int, int] = below) -> int:
            chain = []
            while e not in below and page.parent[e] != around:
                chain.append(e)
                e = page.parent[e]
            top = below.setdefault(e, e)
            below.update(dict.fromkeys(chain, top))
            return top

        first = i == 0 or page.blocks[i - 1][1] != around and inner(page.blocks[i - 1][1]) < 0
        to, apart = i + 1, False
        while to < len(page.blocks) and (top := inner(page.blocks[to][1])) >= 0:
            if HEADINGS.get(page.tag[top], 7) <= rank:
                break
            apart |= page.tag[top] in ("div", "section", "article", "ul", "ol", "dl", "blockquote", "table")
            to += 1
        if apart or first and page.tag[around] in ("section", "div") and to > i + 1:
            out.update(range(i, to))
    return out


def main_text(html_text: str, threshold: float = THRESHOLD) -> str:
    """The blocks of the elements whose paths' fused ratio reaches the threshold times the best,
    joined. A page with nothing but elements that HTML itself sets apart, such as nav, has none."""
    page = scan(html_text)
    page.blocks = [b for b in page.blocks if not page.hidden[b[1]]]
    apart = _comments(page)
    page.blocks = [b for i, b in enumerate(page.blocks) if i not in apart]
    if not page.blocks:
        return ""
    fused, linked = ratios(page)
    best = max((fused[page.path[e]] for _, e, _ in page.blocks if not page.aside[e]), default=0.0)
    if best <= 0:
        return ""
    bar = threshold * best
    regions = _regions(page, {page.section[e] for _, e, _ in page.blocks if fused[page.path[e]] >= bar})
    slights = [-1] * len(page.parent)  # of the region around an element
    for e in range(len(slights)):
        slights[e] = regions[e] if e in regions else slights[page.parent[e]] if e else -1

    def kept(e: int) -> bool:
        p = page.path[e]
        prose = page.article[e] >= 0 or linked[p] <= 0.5
        return slights[e] >= 0 and (fused[p] >= bar or prose and page.slights[e] <= slights[e])

    keep = [kept(e) for _, e, _ in page.blocks]
    for i in range(len(keep) - 1):  # the page's title just above its content
        e = page.blocks[i][1]
        keep[i] |= keep[i + 1] and page.title[e] and page.slights[e] <= page.slights[page.blocks[i + 1][1]]
    return "\n\n".join(b[0] for b, k in zip(page.blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's whole html.

    A null or empty html, or one without content, has the empty text. Null ids and urls stay,
    repeated rows each give a row, extra columns are left out, an empty table gives no rows. A very
    long page takes time and memory in proportion to its length; paths of equal ratio stay or go
    together.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
