"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks (text between block-level tags), each with its
root-to-leaf tag path (names and classes, inline markup left out).  Per path the
text length and the punctuation are summed over the page's blocks; their ratios
to the number of blocks are fused (length ratio x (1 + punctuation ratio)),
smoothed over page order, and thresholded.  The element that holds most of
the text above the threshold is the article; its blocks are kept in page order,
headings and short paragraphs included, without those in menus, headers,
footers, sidebars, notices, adverts, forms or reader comments.  ``article`` (else ``main``) elements are taken in its
place where one of them holds at least a fifth of what passes; of several all are kept but teasers, which are under a
third of the largest and have a linked heading or a single block.

A class, id or role marks such a part only if it is no wrapper: an element with an ``article`` or ``main``
inside or with over half of the page's unlinked text is none of them, nor is a label like ``no-ads`` or
``has-sidebar``; lists of related pages are told from sections on related matters by their links.
A link ends at the next block, an anchor without a target is none; linked paragraphs, headings, list entries and
cells inside the article are kept, but for entries of a list of links where no ``article`` says that it belongs there.

Unclosed and stray tags, comments, CDATA, raw-text elements (script, style ...),
quoted ``>`` and pages cut off anywhere are handled.  A null, empty or textless
page gives an empty text, an empty table an empty result.  Repeated rows are extracted one by one; extra columns
are ignored.  White space (Unicode) inside a block becomes one space.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, table_input
from .words import Batches

#: Elements whose content is never text, that never have an end tag, that do not break a block, that belong to
#: no article, and words of class, id or role that mark other parts of a page.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
OUTSIDE = frozenset("nav footer aside form button fieldset menu dialog".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
    "replies respondlist respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget toc".split()
)
#: Labels that begin so speak of the layout; parts that are told by their links; blocks that are kept though all linked.
LAYOUT = frozenset("has no with without not is hide hidden js".split())
LINKED = frozenset("related recommended promoted toc search skip".split())
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption dt dd pre".split())
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：]")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*|[^>]*)(?:>|\Z)",
    re.S,
)
LABEL = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Element:
    name: str
    path: str
    parent: Element | None
    mark: str  # "": none, "part": by its tag, "label": by its labels or a form, "links": by labels if mostly links
    number: int
    size: float = 0.0
    chars: int = 0
    linked: int = 0
    holds_article: bool = False


@dataclass(slots=True)
class Block:
    text: str
    at: Element
    linked: int = 0
    score: float = field(default=0.0)


def _mark(name: str, attrs: str, in_article: bool) -> tuple[str, str]:
    """The element's mark and its name with labels for the tag path."""
    labels = [a or b or c for _, a, b, c in LABEL.findall(attrs)] if "=" in attrs else []
    tokens = [[w.lower() for w in _WORD.findall(x)] for label in labels for x in label.split()]
    words = {w for t in tokens if t and t[0] not in LAYOUT for w in t}
    path = ".".join([name, *sorted(" ".join(labels).split())])
    if name in ("body", "html"):
        return "", path
    if name in OUTSIDE and name != "form" or (name == "header" and not in_article):
        return "part", path
    marked = words & ({"comment", "comments"} if name in ("article", "main") else MARKS)
    header = not in_article and "header" in words and name in ("div", "section", "table")
    if name == "form" or header or marked - LINKED:
        return "label", path
    return ("links" if marked else ""), path


def _outside(e: Element, total: int) -> bool:
    """Is the element, or one around it, no part of an article?"""
    while e is not None:
        if e.mark == "part":
            return True
        wrapper = e.holds_article or 2 * (e.chars - e.linked) > total
        if e.mark and not wrapper and (e.mark == "label" or 2 * e.linked > e.chars):
            return True
        e = e.parent
    return False


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    root = Element("", "", None, "", 0)
    stack, out, parts, linked, number = [root], [], [], 0, 0
    in_link, articles = 0, 0

    def flush() -> None:
        nonlocal linked, in_link
        in_link = 0
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1], linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text)

    def close(to: int) -> None:
        nonlocal articles
        flush()
        articles -= sum(e.name in ("article", "main") and not e.mark for e in stack[to:])
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in RAW and name != "head":
            if not m["end"] and not m["attrs"].endswith("/"):
                done = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = done.end() if done else end
            continue
        if name in ("br", "hr"):
            parts.append(" ")
        elif name in VOID or name == "head":
            continue
        elif name in INLINE:
            if name == "a":
                in_link = int(not m["end"] and "href" in m["attrs"].lower())
        elif m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            else:
                flush()
        else:
            flush()
            shut = CLOSES.get(name, set())
            if stack[-1].name in shut or stack[-1].name == "p":
                close(len(stack) - 1)
                if stack[-1].name in shut:
                    close(len(stack) - 1)
            mark, label = _mark(name, m["attrs"], articles > 0)
            number += 1
            stack.append(Element(name, f"{stack[-1].path}/{label}", stack[-1], mark, number))
            if name in ("article", "main") and not mark:
                articles += 1
                for e in stack[:-1]:
                    e.holds_article = True
    flush()
    for b in out:
        e = b.at
        while e is not None:
            e.chars, e.linked = e.chars + len(b.text), e.linked + min(b.linked, len(b.text))
            e = e.parent
    return out


def _smooth(x: list[float], radius: int = 1) -> list[float]:
    weights = [math.exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(x)):
        near = [(x[i + d], w) for d, w in zip(range(-radius, radius + 1), weights, strict=True) if 0 <= i + d < len(x)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_scores(found: list[Block]) -> list[float]:
    """The smoothed, fused tag-path ratio of every block: text length a block of its path, times one plus its punctuation marks a block."""
    paths: dict[str, list[float]] = {}
    for b in found:
        p = paths.setdefault(b.at.path, [0.0, 0.0, 0.0])
        p[0] += max(0, len(b.text) - b.linked)
        p[1] += len(PUNCTUATION.findall(b.text))
        p[2] += 1
    fused = {k: (size / n) * (1 + marks / n) for k, (size, marks, n) in paths.items()}
    return _smooth([fused[b.at.path] for b in found])


def _teasers(elements: list[Element], found: list[Block]) -> set[int]:
    """Numbers of the elements whose first heading links elsewhere, or that have nothing but one block."""
    held = {e.number: [0, None] for e in elements}
    for b in found:
        e = b.at
        while e is not None:
            if e.number in held:
                mine = held[e.number]
                mine[0] += 1
                if mine[1] is None and b.at.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    mine[1] = b.linked >= len(b.text)
            e = e.parent
    return {n for n, (size, linked) in held.items() if size < 2 or linked}


def main_text(page: str | None, cut: float = 0.8, trust: float = 0.2) -> str:
    """The article's text; ``cut`` scales the threshold (in standard deviations of the fused ratio), ``trust`` is the share
    of what passes it that ``article`` and ``main`` elements must hold to be believed."""
    found = blocks(page or "")
    text = sum(len(b.text) - min(b.linked, len(b.text)) for b in found)
    found = [b for b in found if not _outside(b.at, text)]
    if not found:
        return ""
    scores = path_scores(found)
    mean = sum(scores) / len(scores)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    threshold = min(cut * deviation, max(scores) * 0.5)
    total = 0.0
    elements: dict[int, Element] = {}
    for b, score in zip(found, scores, strict=True):
        b.score = score
        if score >= threshold and len(b.text) > b.linked:
            gain = (len(b.text) - b.linked) * (1 + len(PUNCTUATION.findall(b.text)) / (1 + len(b.text.split())))
            total += gain
            e = b.at
            while e is not None:
                e.size += gain
                elements[e.number] = e
                e = e.parent
    if not total:
        return " ".join(b.text for b in found if len(b.text) > b.linked)
    named = [e for e in elements.values() if e.name in ("article", "main") and e.size > 0]
    inner = [e for e in named if e.name == "article"] or named
    tagged = inner and max(e.size for e in inner) >= trust * total
    if tagged:  # the page says where its articles are, and what scores is there
        largest = max(e.size for e in inner)
        small = _teasers([e for e in inner if 3 * e.size < largest], found)
        best = {e.number for e in inner} - small
    else:  # the deepest element with most of the text that is above the threshold
        one = max((e for e in elements.values() if e.size >= 0.6 * total), key=lambda e: (e.path.count("/"), e.size, -e.number))
        if one.name in KEPT | {"li"} and one.parent is not None:
            one = one.parent
        best = {one.number}
    texts = []
    for b in found:
        e = b.at
        while e is not None and e.number not in best:
            e = e.parent
        around = b.at.parent or b.at
        entry = tagged or 2 * around.linked <= around.chars  # of a list or table that isn't one of links
        if e is not None and (len(b.text) > b.linked or b.at.name in KEPT or entry):
            texts.append(b.text)
    return " ".join(texts)


def _extract(batches: Batches) -> Batches:
    for batch in batches:
        texts = [main_text(x) for x in batch["html"].to_pylist()]
        yield pa.record_batch(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of ``pages(page_id, url, html)``."""
    return table_input(pages, "page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
