"""The main text of web pages by scores on the tree of their blocks.

A page is read once into a tree of block elements, with the runs of text that stand between two block boundaries.  What is
never an article (menus, headers, footers, sidebars, forms, scripts; notices, adverts and comments by their class, id or
role) is left out while reading.  Each remaining run passes points for its length and commas, less what is linked text,
to the container around it, half of them to the next one and a sixth to the one after.  The container with the most
points, discounted by the share of its text that is linked, is the article; siblings with enough points of their own
are kept beside it.

Pages are independent of each other: one pass of tasks, no shuffle.  Reading is linear in the length of a page: tags end
where a quote-aware pattern says, and once that fails in a page, at the next ``>``; open elements are found by their
name, not by walking the stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read_table, spare

MARK = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][^\s/>]*))")
TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: contents are no text
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg xmp object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption summary td th address".split())
LISTS = frozenset("ul ol dl menu dir table thead tbody tfoot tr colgroup figure details".split())
GONE = frozenset("nav header footer aside form dialog menu button select option optgroup datalist label fieldset legend".split())
CONTAINERS = frozenset("html body div section article main center hgroup search".split())
BLOCKS = LEAVES | LISTS | GONE | CONTAINERS
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
FENCES = frozenset("table td th caption".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: words of class names, ids and roles; those of LASTING also hold for an article inside
PASSING = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adunit banner cookie cookies consent gdpr notice notices alert popup modal overlay toast "
    "announcement header masthead topbar nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip footer copyright contentinfo "
    "search searchbox login signup signin register newsletter subscribe subscription form hidden dialog alertdialog paywall disclaimer".split()
)
LASTING = frozenset(
    "comment comments disqus respond reply replies discussion related recommended recommendations popular trending sidebar aside complementary widget widgets "
    "promo promotion promoted sponsor sponsored sponsors teaser teasers share sharing social".split()
)
GOOD = frozenset("article content main post story entry body text blog".split())
NOT_THIS = frozenset("has with no not without".split())
COMMAS = re.compile("[,،、，]")
SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)]?$")

#: points of containers besides those of their text, and what ancestors get of a run's points
BASE = {"article": 10.0, "main": 5.0, "section": 2.0, "div": 2.0}
SHARES = (1.0, 1 / 2, 1 / 6)
#: points of a sibling that is kept, besides a fifth of the container's
LEAST = 4.0


def hints(attributes: str) -> tuple[int, bool]:
    """(how far an element is left out, as in ``Page.state``; whether it is named like an article)."""
    state, good = 0, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and INVISIBLE.search(value):
            state = 3
        elif name in ("class", "id", "role"):
            for label in value.split():
                found = [x.lower() for x in HINT.findall(label)]
                if NOT_THIS.isdisjoint(found):
                    state = max(state, 2 if not LASTING.isdisjoint(found) else 1 if not PASSING.isdisjoint(found) else 0)
                    good = good or not GOOD.isdisjoint(found)
    return state, good


class Page:
    """The tree of a page: nodes in page order (``tag``, ``parent``, ``last`` node inside, ``good``) and ``runs`` of text
    (node, text, linked characters)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.last, self.good, self.links = ["html"], [-1], [0], [False], [0]
        self.state = [0]  # of a node: 0 is text; left out: 1 but for an article or main inside, 2 but for a main, 3 whatever is inside
        self.runs: list[tuple[int, str, int]] = []
        self.stack, self.at, self.fences = [0], {}, [0]
        self.pieces: list[str] = []
        self.linked, self.link_since, self.in_pre = 0, 0, 0
        self.read(html)
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        self.last[0] = len(self.tag) - 1

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.runs.append((self.stack[-1] if self.tag[self.stack[-1]] in BLOCKS else self.block(), text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def block(self) -> int:
        node = self.stack[-1]
        while self.tag[node] not in BLOCKS:
            node = self.parent[node]
        return node

    def text(self, raw: str) -> None:
        if self.state[self.stack[-1]]:
            return
        piece = unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.link_since:
            self.linked += len(" ".join(piece.split()))

    def push(self, tag: str, state: int, good: bool) -> None:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.last.append(node)
        self.good.append(good)
        self.links.append(0)
        self.state.append(state)
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in FENCES:
            self.fences.append(len(self.stack))
        self.in_pre += tag == "pre"
        self.stack.append(node)

    def pop(self) -> None:
        node = self.stack[-1]
        tag = self.tag[node]
        if tag in BLOCKS:
            self.flush()
        self.stack.pop()
        self.last[node] = len(self.tag) - 1
        self.at[tag].pop()
        if tag in FENCES:
            self.fences.pop()
        self.in_pre -= tag == "pre"
        if self.link_since > len(self.stack):
            self.link_since = 0

    def open(self, tag: str) -> int:
        """The place of the innermost open element of a name, 0 for none."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def close(self, tag: str, above: int) -> None:
        """Close an element, and all in it, if it stands above a place of the stack."""
        place = self.open(tag)
        if place > above:
            while len(self.stack) > place:
                self.pop()

    def start(self, tag: str, attributes: str) -> None:
        top = self.stack[-1]
        if tag in BLOCKS:
            self.flush()
            if tag not in TABLE or tag == "table":
                self.close("p", self.fences[-1])
            for other in CLOSED_BY.get(tag, ()):
                self.close(other, max(map(self.open, HOLDERS[tag])))
            if tag in ("html", "body") and (tag == "html" or self.open("body")):
                return
            top = self.stack[-1]
        elif tag == "br":
            self.text(" ")
            return
        elif tag == "hr":
            self.flush()
            return
        elif tag == "a":
            href = re.search(r"\bhref\b", attributes, re.I) is not None
            self.link_since = len(self.stack) if href else 0
            if href and not self.state[top]:
                self.links[self.block()] += 1
        if tag in VOID:
            return
        state, good = self.state[top], False
        if tag in GONE:
            state = 3
        elif tag == "main" and state < 3 or tag == "article" and state < 2 and not self.open("article"):
            state = 0
        if attributes and state < 3 and not self.in_pre and tag not in ("html", "body", "main"):
            own, good = hints(attributes)
            state = max(state, own if own != 1 or tag != "article" else 0)
        # an inline element is a node only where it is left out, and then so are those of its name inside it
        if tag in BLOCKS or state > self.state[top] or self.tag[top] == tag:
            self.push(tag, state, good)

    def read(self, html: str) -> None:
        at, plain, never = 0, False, set()
        while True:
            found = MARK.search(html, at)
            if found is None:
                self.text(html[at:])
                return
            if found.start() > at:
                self.text(html[at : found.start()])
            declared, slash, tag = found.groups()
            if tag is None:
                end = html.find(">" if declared else "-->", found.end() if declared else found.start() + 2)
                if end < 0:
                    return
                at = end + (1 if declared else 3)
                continue
            tag = tag.lower()
            end = None if plain else TAG_END.match(html, found.end())
            if end is None:
                plain = True
                place = html.find(">", found.end())
                if place < 0:
                    return
                at = place + 1
            else:
                at = end.end()
            attributes = html[found.end() : at - 1]
            if slash:
                self.end(tag)
            elif tag in RAW:
                close = None if tag in never else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if close is not None:
                    at = close.end()
                elif tag in ("script", "style"):
                    return
                else:
                    never.add(tag)
            else:
                self.start(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_since = 0
        if tag in ("br", "hr"):
            self.start(tag, "")
        elif tag in BLOCKS:
            if tag == "table":
                self.close(tag, 0)
            elif tag in TABLE:
                self.close(tag, self.open("table"))
            elif tag == "li":
                self.close(tag, max(map(self.open, HOLDERS["li"])))
            elif tag not in ("html", "body"):
                self.close(tag, self.fences[-1])
        elif self.tag[self.stack[-1]] == tag:
            self.pop()


def main_text(html: str | None) -> tuple[str, str | None, float, int]:
    """(text, name of the container, its points, blocks) of a page; an empty text has no container."""
    page = Page(html or "")
    if not page.runs:
        return "", None, 0.0, 0
    tag, parent, n = page.tag, page.parent, len(page.tag)
    points, size, linked, links, holder = [0.0] * n, [0] * n, [0] * n, page.links[:], [0] * n
    for node in range(1, n):
        holder[node] = node if tag[node] in CONTAINERS or tag[node] in ("td", "th") else holder[parent[node]]
    for node, text, link in page.runs:
        size[node] += len(text)
        linked[node] += link
        own = (len(text) >= 25) + min(len(text) / 100, 3.0) + len(COMMAS.findall(text))
        own *= (1 - link / len(text)) * (0.1 if tag[node] in HEADINGS else 1)
        # a cell with paragraphs is a container, one with text is part of a table
        node = holder[parent[node] if tag[node] in ("td", "th") else node]
        for share in SHARES:
            points[node] += own * share
            if node == 0:
                break
            node = holder[parent[node]]
    for node in range(n - 1, 0, -1):
        size[parent[node]] += size[node]
        linked[parent[node]] += linked[node]
        links[parent[node]] += links[node]
    score = [
        (p + BASE.get(t, 0) + 10 * g) * (1 - x / s) if p > 0 else 0.0 for p, t, g, x, s in zip(points, tag, page.good, linked, size)
    ]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        return "", None, 0.0, 0
    top = best
    while top > 0 and tag[top] != "article":
        top = parent[top]
    top = top or best
    kept = [(top, page.last[top])]
    if top:
        kept += [(i, page.last[i]) for i in siblings(page, top, max(score[best], score[top]), score, size, linked)]
    kept.sort()
    text, k, beside = [], 0, tag[top] not in ("article", "html", "body")
    menus, until = set(), -1
    for node in range(n):
        if node > until and node != top and tag[node] in ("ul", "ol", "dl", "table", "div", "section") and links[node] >= 3 and linked[node] >= 0.75 * size[node]:
            until = page.last[node]
        if node <= until:
            menus.add(node)
    above = parent[top]
    for node, run, link in page.runs:
        inside = any(a <= node <= b for a, b in kept) if len(kept) < 4 else within(kept, node)
        if not inside and beside and node == above:  # a run right in the parent, beside the container
            inside = link <= 0.25 * len(run) and (len(run) >= 80 or link == 0 and SENTENCE_END.search(run) is not None)
        if inside and node not in menus:
            text.append(run)
    return "\n".join(text), tag[top], score[top], len(text)


def within(ranges: list[tuple[int, int]], node: int) -> bool:
    low, high = 0, len(ranges)
    while low < high:
        middle = (low + high) // 2
        if ranges[middle][1] < node:
            low = middle + 1
        else:
            high = middle
    return low < len(ranges) and ranges[low][0] <= node


def siblings(page: Page, top: int, most: float, score: list[float], size: list[int], linked: list[int]) -> Iterator[int]:
    """Siblings with enough points; beside anything but an article also paragraphs, and headings that come before it."""
    tag, above = page.tag, page.parent[top]
    child = above + 1
    while child <= page.last[above]:
        if child != top and size[child] and page.parent[child] == above:
            density = linked[child] / size[child]
            if tag[top] == "article":
                good = (tag[child] in ("article", "section") or page.good[child]) and score[child] >= max(LEAST, most / 5)
            elif tag[child] in HEADINGS:
                good = child < top and not linked[child]
            elif tag[child] in LEAVES:
                good = density <= 0.25 and (size[child] >= 80 or not linked[child])
            else:
                good = density < 0.5 and score[child] >= max(LEAST, most / 5)
            if good:
                yield child
        child = page.last[child] + 1


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text, n_chars, container, score and n_blocks (with ``_`` before a name that ``pages`` has).

    ``text`` is the article: its runs of text in page order, joined by ``\\n``, with character references decoded, white
    space turned into single spaces and both ends trimmed; ``n_chars`` its code points.  The best container is the
    nearest ``article`` around the element with the most points, or that element; of equal ones the first in the page.
    A null or empty page, and one without an article, has an empty text, 0 characters and blocks, no container and
    score 0.  A page without markup is one run.  Repeated rows come back as often as they came; tables may be empty and
    have other columns of any name and type.  Pages are read whole, in memory linear in their length.
    """
    names = spare(pages, "text", "n_chars", "container", "score", "n_blocks")
    at = pages.columns.index(html)
    kinds = (T.StringType(), T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType())
    schema = T.StructType([*pages.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(at)]
            text = [x[0] for x in found]
            more = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            more += [pa.array([x[i] for x in found], kind) for i, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return pages.mapInArrow(run, schema)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op11_html_text": op11_html_text}
