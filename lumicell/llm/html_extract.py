"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks, each with its root-to-leaf path of tags (with
first class names or ids).  Only what is no text of the page at all is left out while
parsing: scripts, styles, form controls, hidden elements.  All else gets a
score by its path, and the scores decide:

1. Ratios.  For each path, text length and punctuation are summed up and
   divided by its blocks.
2. Smoothing.  Both ratios are smoothed over neighbouring blocks in page order.
3. Fusing.  Their geometric mean is discounted by the share of link text and by
   a weak factor for the path's share of the page, and by MARKED for each
   element of the path whose tag, role or class says menu, footer, advert,
   form, comments and the like.
4. Support.  Marks on elements that also hold the best path say nothing and are
   taken back.  A path gets, beside its own score, a part of the best path's:
   NESTED for each level between it and their common ancestor, OUTSIDE for each
   such level of the best path, and OUTSIDE again if the best path is inside an
   article or main element and it is not.  So short list items, cells and
   captions among long paragraphs belong to the article.
5. Threshold.  Paths at or over THRESHOLD of the best path's score are content.
   Headings are content where their parent holds a content path.

Scale.  A page is handled by itself: one pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Share of the best path's score that makes a path content.
THRESHOLD = 0.2
#: Factor of each element that is marked as no article.
MARKED = 0.02
#: Factors of the levels between a path and the best path: on its own side, on the other side.
NESTED, OUTSIDE = 0.7, 0.05
#: Levels that paths tell apart; deeper elements share the path of the last level.
MAX_DEPTH = 64
#: Weights of a block's neighbours, itself in the middle.
SMOOTH = (0.25, 0.5, 0.25)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content ends at the next end tag of that name, whatever it holds.
_RAW_TEXT = frozenset("script style textarea title".split())
_LEFT_OUT = _RAW_TEXT | frozenset("noscript template iframe object svg math select button audio video canvas map datalist".split())
_MARKED_TAG = frozenset("nav aside form dialog menu footer".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
#: Start tags that end an open element of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div body html main td th blockquote".split())
_MARKED_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_MARKED_WORD = frozenset(
    """nav navbar navigation menu menubar sidebar side aside footer foot header masthead topbar toolbar ad ads advert adverts advertisement advertising
    banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay comment comments respond disqus share
    sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget
    search form copyright""".split()
)
#: First words of class names that say something about the element's surroundings or subject, not about the element.
_ABOUT = frozenset("has have no not with without is category tag type format status lang".split())
#: Words that mark a page's header or footer, but not an article's.
_FRAME_WORD = frozenset("header foot footer side".split())
_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
_UNQUOTED = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[^\w\s]")


class Element(NamedTuple):
    """An open element as part of a path."""

    name: str
    tag: str
    marked: bool


@dataclass
class Block:
    path: tuple[Element, ...]
    text: str
    linked: int


class _Open(NamedTuple):
    tag: str
    path: tuple[Element, ...]  # of the innermost block
    link: bool = False  # it is or is inside a link
    block: bool = True


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _name(attrs: dict[str, str]) -> str:
    """First class name, else the id without its number, as part of a path."""
    first = attrs.get("class", "").split()[:1]
    return f".{first[0]}" if first else "#" + attrs["id"].rstrip("0123456789") if attrs.get("id") else ""


def _marked(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether tag, role, class or id say that an element is no article; `inside`: it is part of an article or main element."""
    if tag in _MARKED_TAG or (tag == "header" and not inside) or attrs.get("role", "").lower() in _MARKED_ROLE:
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in _ABOUT and any(w in _MARKED_WORD and not (inside and w in _FRAME_WORD) for w in words):
            return True
    return False


def _tag_end(page: str, pos: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag; quoted values may hold others.  A quote without an end counts as a character."""
    while True:
        pos = _UNQUOTED.match(page, pos).end()
        if pos >= len(page) or page[pos] == ">":
            return pos
        quote = page[pos]
        pos = page.index(quote, pos + 1) + 1 if pos < last[quote] else pos + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", ())]
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = 0
    last = {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(stack[-1].path, text, links))
        links = 0

    def text(a: int, b: int) -> None:
        nonlocal links
        if b > a:
            parts.append(page[a:b])
            if stack[-1].link:
                links += b - a

    def close(names: frozenset | set, within: frozenset = frozenset()) -> None:
        """Close the innermost open element of these names, unless one of `within` is open inside it."""
        if not any(opened.get(t) for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                if any(e.block for e in stack[k:]):
                    flush()
                for e in stack[k:]:
                    opened[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            text(pos, n)
            break
        text(pos, m.start())
        if m[0] == "<!--":
            pos = page.find("-->", m.end())
            pos = n if pos < 0 else pos + 3
            continue
        stop = _tag_end(page, m.end(), last) if m[2] else page.find(">", m.end())
        if stop < 0 or stop >= n:  # a tag that never ends is no text
            break
        pos, tag = stop + 1, (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in _VOID:
                close({tag}, _SCOPE - {tag} if tag in ("p", "li", "td", "th", "tr", "dt", "dd") else frozenset())
            continue
        rest = page[m.end() : stop]
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if rest else {}
        inline = tag in _INLINE
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            close({"p"}, _SCOPE)
            flush()
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPE - _CLOSES[tag])
        if tag == "a":  # links don't nest
            close({"a"}, _SCOPE)
        if tag in _VOID:
            continue
        if tag in _LEFT_OUT or _hidden(attrs):
            if not rest.endswith("/"):
                pos = _behind(page, pos, tag)
            continue
        top, path = stack[-1], stack[-1].path
        opened[tag] = opened.get(tag, 0) + 1
        if inline:
            stack.append(_Open(tag, path, top.link or tag == "a", False))
        else:
            if len(path) < MAX_DEPTH:
                inside = any(e.tag in _ARTICLE for e in path)
                marked = tag not in ("html", "body", "main", "article") and _marked(tag, attrs, inside) or tag == "article" and _marked(tag, attrs, True)
                path = (*path, Element(tag + _name(attrs), tag, marked))
            stack.append(_Open(tag, path, top.link))
    flush()
    return out


def _behind(page: str, pos: int, tag: str) -> int:
    """Behind the end tag that matches a start tag; nested ones of the same name count, except for raw text.

    Raw text without an end tag goes to the page's end; another element without one is taken to be empty.
    """
    if tag in _RAW_TEXT:
        m = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(page, pos)
        return m.end() if m else len(page)
    depth = 1
    for m in re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*+>|\Z)|<(/?){re.escape(tag)}\b[^>]*+>", re.I | re.S).finditer(page, pos):
        if m[2] is None:
            continue
        depth += -1 if m[2] else 0 if m[0].endswith("/>") else 1
        if depth == 0:
            return m.end()
    return pos


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for w, j in zip(SMOOTH, (i - 1, i, i + 1)):
            if 0 <= j < len(values):
                total += w * values[j]
                weight += w
        out.append(total / weight)
    return out


def _shared(a: tuple[Element, ...], b: tuple[Element, ...]) -> int:
    """Levels that two paths have in common from the root."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


def _article_level(path: tuple[Element, ...]) -> int:
    """Level of the outermost article or main element, or 0."""
    return next((k + 1 for k, e in enumerate(path) if e.tag in _ARTICLE), 0)


def path_scores(found: list[Block]) -> dict[tuple[Element, ...], float]:
    """Score of each path, the best path's being 1; empty if no path has any."""
    total = sum(len(b.text) for b in found)
    sums: dict[tuple[Element, ...], list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(b.text), len(_PUNCTUATION.findall(b.text)), b.linked)):
            s[k] += v
    length = _smooth([sums[b.path][1] / sums[b.path][0] for b in found])
    points = _smooth([(sums[b.path][2] + 1) / sums[b.path][0] for b in found])
    own = dict.fromkeys(sums, 0.0)
    for b, t, p in zip(found, length, points):
        s = sums[b.path]
        own[b.path] += math.sqrt(t * p) * max(0.0, 1 - s[3] / max(1.0, s[1])) * (s[1] / total) ** 0.25 / s[0]
    ranked = {p: s * MARKED ** sum(e.marked for e in p) for p, s in own.items()}
    best = max(ranked, key=ranked.get, default=())
    if not ranked or own[best] <= 0:
        return {}
    article = _article_level(best)
    out = {}
    for path, s in own.items():
        k = _shared(path, best)
        mark = MARKED ** sum(e.marked for e in path[k:]) * (OUTSIDE if k < article else 1.0)
        linked = sums[path][3] / max(1.0, sums[path][1])
        support = (NESTED ** max(0, len(path) - k - 1)) * (OUTSIDE ** max(0, len(best) - k - 1)) * (1 - min(1.0, linked) / 2)
        out[path] = mark * (s + support * own[best]) / own[best] if path != best else 1.0
    return out


def content(found: list[Block], threshold: float = THRESHOLD) -> list[Block]:
    """The blocks on content paths."""
    scores = path_scores(found)
    good = {p for p, s in scores.items() if s >= threshold}
    held = {p[:k] for p in good if not p or p[-1].tag not in _HEADING for k in range(len(p))}
    heading = lambda p: bool(p) and p[-1].tag in _HEADING and p[:-1] in held and not any(e.marked for e in p[_level(p, good) :])
    return [b for b in found if b.path in good or heading(b.path)]


def _level(path: tuple[Element, ...], good: set) -> int:
    """Most levels that a path shares with a content path."""
    return max((_shared(path, g) for g in good), default=0)


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """Content blocks joined by line ends; empty for a null or empty page."""
    return "\n".join(b.text for b in content(blocks(page), threshold)) if page else ""


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    A null or empty html, or one without content, gives an empty text.  Very
    long pages are read whole.  Rows that repeat, also with the same or no
    page_id, stay apart; ties between paths go to the first on the page.  An
    empty table gives an empty result; other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out = [main_text(x, threshold) for x in texts(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return src.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
