"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root.  Per path, text length and punctuation are summed and divided by the number of
nodes: the text ratio and the punctuation ratio.  Paths of running text score high on both, paths of menus and links
score low.  Both are fused into one value per path, every node takes the value of its path, the series of nodes in page order is smoothed,
and nodes over a threshold are content.  The element that holds nearly all content text is the article, without parts that its
markup names as something else (menus, forms, comments, adverts and so on), by a whole name: one listed word among others does not count.
Inside it, blocks on paths of low value go as well, such as lists of links.  Headings (those in the header of the article too), paragraphs, text right in the
article, and items and cells that are not mostly links or that carry the punctuation of references, are kept however short.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gatehouse.llm.arrow import with_columns

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
# Elements that end an open paragraph; those that end their open sibling of a kind.
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "main", "body", "html"}
LISTED = SCOPE.union(*SIBLINGS.values())
# Elements whose text is never part of an article.
NEVER = {
    "head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas",
    "object", "menu", "dialog", "title", "audio", "video", "label",
}
# Words in a class, id or role that name such a part.
NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary", "header", "masthead", "footer", "contentinfo", "comment", "comments", "commentlist", "reply", "replies",
    "disqus", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "login", "search", "share",
    "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "form",
}
# Words of a name that say nothing of what it holds: "site-footer" is a footer, but "share-price" is no share bar.
LAYOUT = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "global", "group", "icon", "icons", "inner", "item", "items", "left", "link", "links",
    "list", "main", "outer", "page", "panel", "right", "row", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper",
}
# Inside an article these name its own head: the headline and what stands with it.
TITLES = {"header", "masthead"}
# Names that hold articles of their own, one a comment; and elements whose mark is as weak as a name.
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "disqus"}
WEAK = {"form"}
CONTAINER = {"article", "main", "section", "div", "body", "html", "td", "blockquote", "center", "table", "tbody", "tr"}
# Share of the content text that the article element must hold.
SHARE = 0.8
# Inside the article, a block is on paths of low value below this share of the mean value of the text.
LOW = 0.1
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Blocks of low value that stay unless half of their text or more is links.
RESCUED = {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "caption", "figcaption"}
# Text right in one of these, and paragraphs even if they are links.
DIRECT = {"article", "main", "section"}
PARAGRAPHS = {"p", "pre", "blockquote"}
# Marks of punctuation for each text node of a path from which on linked items are references, not a menu.
CITED = 0.5
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?、。，]")
_KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)


class _Nodes(HTMLParser):
    """Text nodes in page order: text, path, block number, whether inside a part that is not content, chain of elements.

    The stack of open elements is never searched: every entry knows the nearest entries that can end a search, so the time is linear in
    the page whatever its tags.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = [_Open("", 0, False, 0, 0, 0)]
        self.places: dict[str, list[int]] = {}  # of each tag, where it stands open in the stack
        self.parent: list[int] = [0]
        self.tags: list[str] = [""]
        # Paths are numbered as (number of the parent path, tag), whatever their depth.
        self.paths: list[int] = [0]
        self.numbers: dict[tuple[int, str], int] = {}
        self.last: list[str] = [""]
        self.count = 0
        self.block = 0
        self.nodes: list[tuple[str, int, int, bool]] = []  # text, element, block, not content whatever it holds
        self.named: dict[int, set[str]] = {}  # elements that a name or <form> marks as not content, unless they hold the article

    def _close(self, upto: int) -> None:
        if any(x.tag in BLOCK for x in self.stack[upto:]):
            self.block += 1
        while len(self.stack) > upto:
            self.places[self.stack.pop().tag].pop()

    def _inside_article(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and self.stack[self.stack[-1].block].tag == "p":
            self._close(self.stack[-1].block)
        if tag in SIBLINGS:
            # The entries on the way are of unlike kinds: few between two that end the search.
            k = self.stack[-1].listed
            while k and self.stack[k].tag not in SIBLINGS[tag] and self.stack[k].tag not in SCOPE:
                k = self.stack[k - 1].listed
            if k and self.stack[k].tag in SIBLINGS[tag]:
                self._close(k)
        top = self.stack[-1]
        if tag == "br":
            self.nodes.append((" ", top.element, self.block, top.out))
        if tag in BLOCK:
            self.block += 1
        if tag in VOID:
            return
        self.count += 1
        self.parent.append(top.element)
        self.tags.append(tag)
        path = self.paths[top.element]
        if self.last[path] != tag or tag not in ("b", "i", "em", "span", "font"):
            path = self.numbers.setdefault((path, tag), len(self.numbers) + 1)
            if path == len(self.last):
                self.last.append(tag)
        self.paths.append(path)
        inside = self._inside_article()
        marks = _marks(tag, attrs) - (TITLES if inside else set())
        if marks:
            self.named[self.count] = marks
        never = tag in NEVER - WEAK and not (inside and tag in TITLES)
        at = len(self.stack)
        self.stack.append(_Open(tag, self.count, top.out or never or _hidden(tag, attrs), at if tag in BLOCK else top.block, at if tag in BLOCK and tag != "p" else top.wall, at if tag in LISTED else top.listed))
        self.places.setdefault(tag, []).append(at)

    def feed(self, data: str) -> None:
        """A page at once.  What begins a tag or a comment that is never closed ends it, as browsers do."""
        self.whole, self.tag_end, self.comment_end = len(data), data.rfind(">"), data.rfind("-->")
        super().feed(data)

    def _unclosed(self, i: int, last: int) -> bool:
        return self.whole - len(self.rawdata) + i > last

    def parse_starttag(self, i: int) -> int:
        return len(self.rawdata) if self._unclosed(i, self.tag_end) else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return len(self.rawdata) if self._unclosed(i, self.tag_end) else super().parse_endtag(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return len(self.rawdata) if self._unclosed(i, self.comment_end) else super().parse_comment(i, report)

    def parse_pi(self, i: int) -> int:
        return len(self.rawdata) if self._unclosed(i, self.tag_end) else super().parse_pi(i)

    def parse_html_declaration(self, i: int) -> int:
        return len(self.rawdata) if self._unclosed(i, self.tag_end) else super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash has no meaning for elements that are not void

    def handle_endtag(self, tag: str) -> None:
        open_ = self.places.get(tag)
        if not open_:
            self.block += tag == "p"
        elif tag in BLOCK or self.stack[-1].wall <= open_[-1]:  # a stray inline end tag does not close blocks
            self._close(open_[-1])

    def handle_data(self, data: str) -> None:
        self.nodes.append((data, self.stack[-1].element, self.block, self.stack[-1].out))


class _Open(NamedTuple):
    """An open element: tag, number, whether it is not content; and where in the stack the nearest entry is, itself included, that is a block, a block other
    than a paragraph, or an entry that ends the search for an open sibling."""

    tag: str
    element: int
    out: bool
    block: int
    wall: int
    listed: int


def _hidden(tag: str, attrs: list) -> bool:
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marks(tag: str, attrs: list) -> set[str]:
    """Listed words that mark the element as not content: those of a name that has no other words but words of layout."""
    if tag in ("html", "body", "main"):
        return set()
    marks = {tag} if tag in WEAK else set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                marks |= words & NAMES if words <= NAMES | LAYOUT else set()
    return marks


def _foreign(page: _Nodes) -> list[bool]:
    """Elements in a part that a name or ``<form>`` marks as not content.

    A mark does not count on an element that holds an ``<article>`` or ``<main>``, if none outside such parts has more running text, nor
    on one that holds the share SHARE of the running text of the page, unless an ``<article>`` with text stands beside it.  Comments
    only go for an article if there is none outside at all.
    """
    count, named = page.count, page.named
    if not named:
        return [False] * (count + 1)
    nodes = [n for n in page.nodes if not n[3]]
    chosen, _, _ = _content(nodes, page.paths)

    def below() -> list[bool]:
        out = [False] * (count + 1)
        for e in range(1, count + 1):
            out[e] = out[page.parent[e]] or e in named and e not in excused
        return out

    excused: set[int] = set()
    out = below()
    mass, clean, words = [0.0] * (count + 1), [0.0] * (count + 1), [0] * (count + 1)
    holds = [t in ("article", "main") for t in page.tags]
    for (text, element, _, _), content in zip(nodes, chosen):
        words[element] += 0 if out[element] else len(text.strip())
        if content:
            mass[element] += len(text.strip())
            clean[element] += 0 if out[element] else len(text.strip())
    best = 0.0
    for e in range(count, 0, -1):
        if page.tags[e] in ("article", "main"):
            best = max(best, clean[e])
        up = page.parent[e]
        mass[up] += mass[e]
        words[up] += words[e]
        clean[up] += clean[e]
        holds[up] = holds[up] or holds[e]
    articles = [e for e in range(1, count + 1) if page.tags[e] == "article" and words[e]]
    around = [False] * (count + 1)
    for e in range(1, count + 1):
        around[e] = around[page.parent[e]] or page.tags[e] == "article"
    for e, marks in named.items():
        most = mass[e] >= SHARE * mass[0] and (around[e] or not articles)
        if (holds[e] or most) and mass[e] > best and not (best and marks & COMMENTS):
            excused.add(e)
    return below() if excused else out


def _content(nodes: list, paths: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text nodes are content: fused path ratios, smoothed over the page, against their threshold.  The ratios, as a share
    of their mean over the text.  And the punctuation ratio alone."""
    lengths = np.array([len(t.strip()) for t, _, _, _ in nodes], float)
    marks = np.array([len(_PUNCT.findall(t)) for t, _, _, _ in nodes], float)
    names: dict[int, int] = {}
    path = np.array([names.setdefault(paths[e], len(names)) for _, e, _, _ in nodes])
    seen = lengths > 0
    n = np.maximum(np.bincount(path, weights=seen), 1)
    dots = np.bincount(path, weights=marks) / n
    fused = (np.bincount(path, weights=lengths) / n) * (1 + dots)
    series = np.where(seen, fused[path], 0.0)
    # The smoothed value only compares nodes with text.
    at = np.flatnonzero(seen)
    if not len(at):
        return seen, series, dots[path]
    padded = np.pad(series[at], 2, mode="edge")
    smooth = np.convolve(padded, _KERNEL / _KERNEL.sum(), mode="valid")
    out = np.zeros(len(nodes), bool)
    out[at] = smooth >= 0.5 * smooth.mean()
    return out, series / (series @ lengths / lengths.sum()), dots[path]


def main_text(html: str | None) -> str:
    """Text of the article of a page, one block a line; empty for null, empty pages and pages without content."""
    if not html:
        return ""
    page = _Nodes()
    page.feed(html)
    page.close()
    foreign = _foreign(page)
    nodes = [n for n in page.nodes if not n[3] and not foreign[n[1]]]
    if not any(t.strip() for t, _, _, _ in nodes):
        return ""
    chosen, value, dots = _content(nodes, page.paths)
    # Content text under each element; from the root down, the child that holds nearly all of it.
    mass = [0.0] * (page.count + 1)
    for (text, element, _, _), content in zip(nodes, chosen):
        if content:
            mass[element] += len(text.strip())
    for e in range(page.count, 0, -1):  # a child has a higher number than its parent
        mass[page.parent[e]] += mass[e]
    best = 0
    children: dict[int, list[int]] = {}
    for e in range(1, page.count + 1):
        children.setdefault(page.parent[e], []).append(e)
    while True:
        heavy = [e for e in children.get(best, []) if mass[e] >= SHARE * mass[0] and page.tags[e] in CONTAINER]
        if not heavy:
            break
        best = heavy[0]
    above = best
    while above:
        if page.tags[above] in ("article", "main"):
            best = above
            break
        above = page.parent[above]
    # A whole page as the article: then only nodes found to be content count, with the headings that stand before them.
    whole = page.tags[best] in ("", "html", "body")
    inside = [False] * (page.count + 1)
    inside[best] = True
    for e in range(best + 1, page.count + 1):
        inside[e] = inside[page.parent[e]]
    linked, holder = [False] * (page.count + 1), [""] * (page.count + 1)
    for e in range(1, page.count + 1):
        tag, up = page.tags[e], page.parent[e]
        linked[e] = linked[up] or tag == "a"
        # The nearest element that decides: a container inside an item or a cell takes its place.
        own = tag in HEADINGS or tag in RESCUED or tag in DIRECT
        holder[e] = tag if own else holder[up] if tag not in BLOCK or holder[up] in RESCUED else ""
    blocks: dict[int, list[str]] = {}
    sums: dict[int, np.ndarray] = {}  # text, its value, its punctuation ratio, text in links
    kept: dict[int, bool] = {}
    headed: set[int] = set()
    for (text, element, block, _), content, v, dot in zip(nodes, chosen, value, dots):
        if inside[element]:
            blocks.setdefault(block, []).append(text)
            n = len(text.strip())
            sums[block] = sums.get(block, 0) + np.array([n, n * v, n * dot, n * linked[element]])
            if n and (holder[element] in HEADINGS or holder[element] in PARAGRAPHS and not whole):
                headed.add(block)
            kept[block] = kept.get(block, False) or (bool(content) if whole else n > 0 and (holder[element] in RESCUED or holder[element] in DIRECT))
    for block, (n, v, dot, links) in sums.items():
        kept[block] = block in headed or (kept[block] if whole else v >= LOW * n or kept[block] and (2 * links < n or dot >= CITED * n))
    lines = [_SPACE.sub(" ", "".join(parts)).strip() for block, parts in blocks.items() if kept[block]]
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with ``text`` and ``n_chars``, its code points; one row out for each row in.

    Null and empty pages and pages without content have an empty text.  Nothing is capped.  Columns ``text`` and
    ``n_chars`` of the input are replaced, all others stay.
    """
    def make(values: list) -> list:
        texts = [main_text(v).encode("utf-8", "replace").decode() for v in values]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_columns(pages, html, {"text": T.StringType(), "n_chars": T.LongType()}, make, keep)
