"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with their place in the tree. A linear classifier gives each block the log-odds of
being content, from its own tags, class names, length, links and the share of the page's text that its container holds;
these are the capacities to the two terminals. Neighbours in page order are tied by smoothness edges, stronger the fewer
steps lie between their containers in the tree, and blocks of one container by further ones. The minimum cut is the
labelling with the least cost: max-flow pushes through the graph, and what the source still reaches is content. A short
line or one of links stays with the paragraphs around it, a lone sentence between boxes goes with these. Blocks that can't be text of the article by the page's own markup (menus, forms, scripts)
are tied to the boilerplate side by more than their edges can carry.

Scale: a page is a row and nothing is shuffled; the graph has one node a block and at most two edges for each.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.names import col, free

#: Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg canvas head title select option textarea button audio video".split())
BARRED = frozenset("nav header footer aside form dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br"}
#: Words of class, id and role values that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice paywall pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search alert".split()
)
GOOD = frozenset("article body content entry main post story text".split())
#: Words that mark readers' comments in some pages and a section of an article in others: half a noise word.
DOUBTFUL = frozenset("discussion feedback".split())
#: First words of a class that tells about the page's layout, not about its element.
LAYOUT = frozenset("has have hide no not show with without".split())
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z]+")

#: What may stand in a head; anything else starts the body, whether or not the head was left.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())

#: Log-odds of content: constant, in article or main (less by its noise), heading or paragraph, good name, noise word (half if the same element has a good name), each share of linked text, log length,
#: share of the page's unlinked text outside barred elements that the block's container holds (none for a noise word, half for half of one).
WEIGHTS = {"bias": -0.25, "article": 3.0, "plain": 0.8, "good": 1.0, "noise": -5.0, "links": -3.0, "length": 0.35, "share": 2.5}
#: Edges: of neighbours under one parent (less by the steps between their parents), of the next block under the same parent.
BARRED_COST, ADJACENT, SIBLING = 1e6, 1.0, 0.6
#: Steps after which containers are equally far.
FAR = 8


class _Blocks(HTMLParser):
    """Reads a page into blocks ``(text, odds, parent)``; unclosed and misnested tags are taken as browsers take them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool, int, float]] = [("#root", False, False, False, 0, 0.0)]  # tag, barred, article, good, node, noise
        self.unseen: list[str] = []
        self.nodes, self.read = 0, []
        self.above: list[int] = [0]  # parent by node
        self.depth: list[int] = [0]
        self._start()

    def _start(self) -> None:
        self.text, self.linked, self.place = [], 0, None

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            tag, barred, article, good, parent, noise = self.place
            linked = min(1.0, self.linked / len(text))
            w = WEIGHTS
            odds = w["bias"] + w["article"] * article * (1 - noise) + w["good"] * good + w["noise"] * noise + w["plain"] * (tag in ("p", "h1", "h2", "h3", "blockquote", "pre"))
            odds += w["links"] * linked * (not article) + w["length"] * math.log1p(len(text) / 40)
            self.read.append((text, None if barred else odds, parent, len(text) * (1 - linked) * (not barred), 1 - noise))
        self._start()

    def blocks(self) -> list[tuple[str, float, int]]:
        """``(text, odds, parent)`` of every block, with the share of its container in the page's text, which is known at the end only."""
        held: dict[int, float] = {}
        for _, _, parent, own, _ in self.read:
            held[parent] = held.get(parent, 0.0) + own
        whole = sum(held.values()) or 1.0
        share = WEIGHTS["share"] / whole
        return [(text, -BARRED_COST if odds is None else odds + share * held[parent] * clean, parent) for text, odds, parent, _, clean in self.read]

    def steps(self, a: int, b: int, most: int) -> int:
        """Steps between two elements in the tree, at most ``most``."""
        for n in range(most):
            if a == b:
                return n
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
        return most

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag == "body" and self.unseen[0] == "head" or self.unseen == ["head"] and tag not in IN_HEAD:
                self.unseen.clear()
            elif tag == self.unseen[-1] and tag not in ("head", "option", "button") or self.unseen == ["head"] and tag in UNSEEN and tag != "head":
                self.unseen.append(tag)  # an option or a button ends the one before
            if self.unseen or tag in UNSEEN:
                return
        if tag in BLOCK:
            self.flush()
        if tag in UNSEEN:
            self.unseen.append(tag)
            return
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", BLOCK - {"p"})
        if tag in ("li", "td", "th", "tr", "dd", "dt"):
            self._close(tag, frozenset(("ul", "ol", "table", "dl", "div", "section", "article")))
        words = [_NAMES.findall(name) for k, v in attrs if k in ("class", "id", "role") and v for name in v.lower().split()]
        names = {n for w in words if w and w[0] not in LAYOUT for n in w}
        hidden = any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        _, barred, article, good, _, noise = self.stack[-1]
        own = tag in BARRED and not (tag == "header" and article) or hidden
        if tag in ("article", "main"):
            noise = noise if article or names & NOISE and not names & GOOD else 0.0  # words of the wrappers around it don't count
        elif names & NOISE and tag not in ("html", "body"):
            noise = max(noise, 0.5 if names & GOOD else 1.0)
        elif names & DOUBTFUL:
            noise = max(noise, 0.5)
        self.nodes += 1
        self.above.append(self.stack[-1][4])
        self.depth.append(len(self.stack))
        self.stack.append((tag, barred or own, article or tag in ("article", "main"), good or bool(names & GOOD), self.nodes, noise))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag != "svg":  # a slash has no meaning in HTML, but in SVG
            self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stop: frozenset) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
                return
            if self.unseen != ["option"] or tag not in ("datalist", "optgroup", "select"):
                return
            self.unseen.clear()  # the end of what holds an option ends it
        if tag in BLOCK:
            self.flush()
        if tag in BLOCK:
            # An end tag of a block closes what is still open inside; one that matches nothing is ignored.
            self._close(tag, frozenset())
        else:
            self._close(tag, BLOCK)

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if self.unseen:
            return
        if data.strip():
            if self.place is None:
                tag, barred, article, good, _, noise = self.stack[-1]
                inner = next((s for s in reversed(self.stack) if s[0] in BLOCK or s[0] == "#root"), self.stack[0])
                at = self.stack.index(inner)
                self.place = (inner[0], barred, article, good, self.stack[max(0, at - 1)][4], noise)
            if any(s[0] == "a" for s in self.stack):
                self.linked += len(data)
        self.text.append(data)


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    A node has an edge from the source with its positive odds or to the sink with its negative ones; ``edges`` join two
    nodes both ways. Shortest augmenting paths in levels, without recursion. At a tie the source keeps only what it still reaches.
    """
    n = len(odds)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)

    for k, o in enumerate(odds):
        if o > 0:
            join(source, k, o, 0.0)
        elif o < 0:
            join(k, sink, -o, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in head[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path, x = [0] * (n + 2), [], source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
            while turn[x] < len(head[x]):
                e = head[x][turn[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(head[x]):
                path.append(head[x][turn[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                turn[x] += 1
            else:
                break


def label(page: _Blocks) -> list[bool]:
    """Which blocks of a page that was read are content: the minimum cut over page order and common parents."""
    edges, last = [], {}
    blocks = page.blocks()
    for k, (_, _, parent) in enumerate(blocks):
        if k:
            edges.append((k - 1, k, ADJACENT / (1 + page.steps(blocks[k - 1][2], parent, FAR))))
        if parent in last:
            edges.append((last[parent], k, SIBLING))
        last[parent] = k
    return min_cut([o for _, o, _ in blocks], edges)


def read(html: str) -> _Blocks:
    """A page in blocks."""
    page = _Blocks()
    page.feed(html)
    page.close()
    page.flush()
    return page


def extract(html: str | None) -> str:
    """The content blocks of a page in page order, joined by a line feed; empty for null, empty or textless pages."""
    if not html:
        return ""
    page = read(html)
    return "\n".join(text for (text, *_), keep in zip(page.read, label(page), strict=True) if keep)


def main_text(html: Column) -> Column:
    """A column with the main text of a column of pages."""

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(h) for h in part], dtype="object")

    return of(html.cast("string"))


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, and ``n_chars``, its length in code points.

    Text that the page itself hides (``hidden``, ``display:none``) is no text of the article. Null and empty pages give empty text. Repeated rows keep their rows; an empty table stays empty. Columns that
    have the new names are replaced.
    """
    name = free(pages.columns, "__text")
    out = pages.withColumn(name, main_text(col(html_col)))
    kept = [col(n) for n in pages.columns if n.lower() not in {html_col.lower(), text_col.lower(), "n_chars"}]
    return out.select(*kept, F.col(name).alias(text_col), F.char_length(name).cast("long").alias("n_chars"))
