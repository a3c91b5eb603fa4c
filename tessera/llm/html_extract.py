"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is parsed into blocks: the text between two boundaries of block-level elements. A logistic classifier over a block's
words, links and surroundings gives calibrated costs of calling it content or boilerplate; these are
the capacities to the two terminals of a graph, in which edges between blocks next to one another, and
between blocks of the same parent, make a change of label cost the more the closer they stand in the DOM. The
blocks on the source's side of a minimum cut are the main text. So what a block says itself decides long ones and those in plain
surroundings, and its neighbours decide short ones.

The classifier is fitted (:func:`fit`) on labelled blocks of pages that :func:`labelled_pages` composes: articles amid menus, adverts, notices,
forms, comments and footers, with telling, misleading and plain markup. Their number is a parameter; how much a change of label costs is
chosen on pages that the weights have not seen. No name or element alone removes a text.

Null and empty pages, and those without content, give an empty string. Markup may be broken: unclosed
and misnested elements end where their parents do, and an unclosed drawing where HTML begins again. Parsing is linear in the length of a page
whatever its nesting; long pages are extracted whole. Pages that repeat are extracted alike; other columns of the input are not read, so they may have any names.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head script style title noscript template svg math iframe object audio video canvas textarea select button map applet noframes datalist".split())
#: An open element of the second kind ends where a tag of the first starts, unless a tag of the third stands between.
IMPLIED_END = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
PARAGRAPH_ENDS = BLOCK_TAGS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
OUTSIDE = frozenset("nav aside footer header form menu dialog fieldset search".split())
INSIDE = frozenset(("article", "main"))
BAD_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads adv advert advertisement adbox adsense banner promo sponsor sponsored notice cookie cookies consent gdpr popup modal overlay alert toolbar "
    "comment comments disqus replies reply respond sharing social follow subscribe subscription newsletter signup login register related recommend recommended trending popular breadcrumb breadcrumbs crumbs "
    "pagination pager copyright disclaimer skip widget widgets paywall".split()
)
#: Names that boilerplate bears, and articles too.
DOUBTFUL_NAMES = frozenset("side discussion share search form legal tag tags print meta byline".split())
GOOD_NAMES = frozenset("article articles main content contents post entry story text body blog articlebody prose maincontent".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SCALE = 1000
PAGES = 500


@dataclass(slots=True)
class Node:
    """An element, with what its ancestors say of a block in it."""

    tag: str
    depth: int
    region: int = 0  # the nearest telling element: 1 inside an article, -1 outside
    bad: bool = False
    doubtful: bool = False
    good: bool = False
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    links: float  # share of characters in links
    apart: int  # steps in the DOM from the block before


class _Blocks(HTMLParser):
    """Blocks of a page. Only block-level elements are kept on a stack; of others links and silent ones matter."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", 0)]
        self.at: dict[str, list[int]] = {}  # places of open elements by tag
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = self.low = 0
        self.link: int | None = None  # how deep the open link is
        self.silent: tuple[str, int] | None = None  # the outermost silent element and how deep it is
        self.nested = 0

    def _cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                depth = len(self.open)
                last = self.blocks[-1].node.depth + 1 if self.blocks else depth
                self.blocks.append(Block(text, self.open[-1], min(1.0, self.linked / len(text)), last + depth - 2 * min(self.low, depth)))
                self.low = depth
            self.text, self.linked = [], 0

    def _end(self, k: int) -> None:
        """Close the open elements from place ``k``."""
        self._cut()
        for node in reversed(self.open[k:]):
            self.at[node.tag].pop()
        del self.open[k:]
        self.low = min(self.low, k)
        if self.link is not None and self.link > k:
            self.link = None
        if self.silent is not None and self.silent[1] > k:
            self.silent = None

    def _place(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent is not None:
            name, depth = self.silent
            if (name in ("svg", "math") and tag in BLOCK_TAGS) or (name == "head" and (tag in BLOCK_TAGS)):
                self.silent = None
            else:
                self.nested += tag == name
                return
        if tag in SILENT_TAGS:
            self.silent, self.nested = (tag, len(self.open)), 1
            return
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.link = len(self.open)
        if tag not in BLOCK_TAGS:
            return
        if tag in IMPLIED_END:
            ends, stops = IMPLIED_END[tag]
            if (k := self._place(ends)) > self._place(stops):
                self._end(k)
        if tag in PARAGRAPH_ENDS and self.open[-1].tag == "p":
            self._end(len(self.open) - 1)
        self._cut()
        if tag in VOID_TAGS:
            return
        up = self.open[-1]
        node = Node(tag, len(self.open), up.region, up.bad, up.doubtful, up.good, up.hidden)
        if tag in INSIDE:  # the nearest of what tells counts
            node.region, node.bad = 1, False
        elif tag in OUTSIDE and not (tag == "header" and up.region == 1):  # an article's own header holds its title
            node.region = -1
        for k, v in attrs:
            v = (v or "").lower()
            if k in ("class", "id") and tag not in ("html", "body"):
                names = re.findall(r"[a-z]+", v)
                if tag not in INSIDE and not BAD_NAMES.isdisjoint(names):
                    node.bad, node.region = True, min(0, node.region)
                node.doubtful |= not DOUBTFUL_NAMES.isdisjoint(names)
                node.good |= not GOOD_NAMES.isdisjoint(names)
            elif k == "role":
                node.region = -1 if v in BAD_ROLES else 1 if v in ("main", "article") else node.region
            elif k == "itemprop" and v in ("articlebody", "text"):
                node.region = 1
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
                node.hidden = True
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in SILENT_TAGS and tag not in ("script", "style") and self.silent is None:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent is not None and tag == self.silent[0]:
            self.nested -= 1
            if self.nested <= 0:
                self.silent = None
            return
        if tag == "a":
            self.link = None
        elif tag in BLOCK_TAGS and (self.silent is None or self.silent[0] != "head"):
            if self.at.get(tag):
                self._end(self.at[tag][-1])
            elif self.silent is None:
                self._cut()

    def handle_data(self, data: str) -> None:
        if self.silent is None:
            self.text.append(data)
            if self.link is not None:
                self.linked += len(data.strip())


def parse(html: str) -> list[Block]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p._cut()
    return p.blocks


#: Features of a block, in order. ``bad_most``: under a bad name, the more so, the more of the page's words are under none.
FEATURES = ("one", "words", "links_short", "links_long", "sentence", "commas", "heading", "paragraph", "item", "inside", "outside", "bad", "bad_most", "doubtful_short", "good", "hidden", "copyright")


def features(blocks: list[Block]) -> list[list[float]]:
    sizes = [b.text.count(" ") + 1 for b in blocks]
    free = sum(n for n, b in zip(sizes, blocks, strict=True) if not (b.node.bad or b.node.region < 0)) / max(1, sum(sizes))
    if any(b.node.region > 0 for b in blocks):  # the page says where its article is
        free = 1.0
    out = []
    for n, b in zip(sizes, blocks, strict=True):
        tag, text, node = b.node.tag, b.text, b.node
        out.append([
            1.0, math.log1p(n), b.links * (n < 12), b.links * (n >= 12), float(text[-1] in ".!?\"'”»…:"), min(1.0, 8 * text.count(",") / n), float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(tag in ("p", "pre", "blockquote")), float(tag in ("li", "td", "th", "dt", "dd", "option")), float(node.region > 0), float(node.region < 0), float(node.bad), node.bad * min(1.0, 3 * free),
            float(node.doubtful and n < 12), float(node.good), float(node.hidden), float(bool(re.match(r"(?:©|\(c\)|copyright\b|all rights reserved)", text, re.I))),
        ])
    return out


def min_cut(n: int, to_content: list[int], to_rest: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Sides of a minimum cut (True: the source's) by Dinic's algorithm. Capacities are integers."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def add(a: int, b: int, c: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        common = min(to_content[i], to_rest[i])
        if to_content[i] > common:
            add(s, i, to_content[i] - common, 0)
        elif to_rest[i] > common:
            add(i, t, to_rest[i] - common, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:  # one augmenting path at a time, without recursion
            path: list[int] = []
            v = s
            while v != t:
                while at[v] < len(head[v]) and not (cap[e := head[v][at[v]]] and level[to[e]] == level[v] + 1):
                    at[v] += 1
                if at[v] < len(head[v]):
                    path.append(head[v][at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
            if v != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


@dataclass
class Model:
    weights: list[float]
    smooth: float = 0.0  # what a change of label costs between blocks next to one another


def labels(blocks: list[Block], model: Model) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    if not blocks:
        return []
    odds = [max(-30.0, min(30.0, sum(w * x for w, x in zip(model.weights, row, strict=True)))) for row in features(blocks)]
    cost = lambda x: int(SCALE * math.log1p(math.exp(x)))
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i and (c := int(SCALE * model.smooth / max(1, b.apart))):
            edges.append((i - 1, i, c))
        parent = id(b.node)
        if (j := last.get(parent, i - 1)) < i - 1:
            edges.append((j, i, int(SCALE * model.smooth / 2)))
        last[parent] = i
    return min_cut(len(blocks), [cost(x) for x in odds], [cost(-x) for x in odds], edges)


_WORDS = "the a of and to in is that it was for on are with as be at one have this from by hot word but what some we can out other were all there when up use your how said an each she".split()


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, list[bool]]]:
    """Pages and, for each block in their order, whether it is content."""
    r = random.Random(seed)
    word = lambda: r.choice(_WORDS) if r.random() < 0.6 else "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 9)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def prose(a: int, b: int) -> str:
        out = some(a, b).split()
        out = [w + "," if r.random() < 0.07 else w + "." if r.random() < 0.08 else w for w in out]
        return " ".join(out).capitalize().rstrip(",.") + "."

    bad, doubtful, good = sorted(BAD_NAMES), sorted(DOUBTFUL_NAMES), sorted(GOOD_NAMES)
    name = lambda x: f' {r.choice(("class", "id"))}="{x}"'
    for _ in range(n):
        html, truth = [], []

        def put(tag: str, text: str, content: bool, link: bool = False) -> None:
            html.append(f"<{tag}>" + (f'<a href="#">{text}</a>' if link else text) + f"</{tag}>")
            truth.append(content)

        def boilerplate(kind: str) -> None:
            semantic = {"nav": "nav", "ad": "aside", "footer": "footer", "form": "form", "comments": "section", "notice": "div", "related": "aside", "header": "header", "share": "div"}[kind]
            names = {"nav": "nav menu navbar", "ad": "ad advert banner promo", "footer": "footer copyright", "form": "newsletter signup subscribe", "comments": "comments comment replies", "notice": "notice cookie alert", "related": "related sidebar popular", "header": "header masthead banner", "share": "share tags meta byline print"}[kind].split()
            tag = semantic if r.random() < 0.6 else "div"
            telling = kind in ("ad", "notice", "comments", "share") or tag == "div"
            html.append(f"<{tag}{name(r.choice(names)) if telling and r.random() < 0.93 else name(r.choice(good)) if r.random() < 0.04 else name(r.choice(doubtful)) if r.random() < 0.1 else ''}{' hidden' if kind == 'notice' and r.random() < 0.2 else ''}>")
            if kind in ("nav", "related"):
                html.append("<ul>")
                for _ in range(r.randint(3, 8)):
                    put("li", some(1, 3 if kind == "nav" else 12), False, r.random() < 0.95)
                html.append("</ul>")
            elif kind == "comments":
                for _ in range(r.randint(1, 5)):
                    put("p", prose(3, 60), False)
            elif kind == "footer":
                put("p", ("&copy; " if r.random() < 0.6 else "") + some(2, 14), False)
            elif kind == "share":
                put(r.choice(("div", "span")), some(1, 10), False, r.random() < 0.3)
            elif kind == "form":
                put("label", some(1, 4), False)
                truth.pop()
                put("p", some(2, 12), False)
                html[-2:] = [html[-1]]
            else:
                put(r.choice(("p", "div")), prose(2, 16) if r.random() < 0.7 else some(1, 10), False, r.random() < 0.2)
            html.append(f"</{tag}>")

        html.append("<html><body>")
        for kind in ("header", "nav", "notice", "ad"):
            if r.random() < 0.6:
                boilerplate(kind)
        tag = r.choice(("article", "main", "div", "div"))
        html.append(f"<{tag}{name(r.choice(good)) if r.random() < 0.45 else name(r.choice(bad)) if r.random() < 0.15 else name(r.choice(doubtful)) if r.random() < 0.25 else ''}>")
        put("h1", some(2, 12), True)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.68:
                put("p", prose(1, 4) if r.random() < 0.15 else prose(6, 120), True, r.random() < 0.03)
            elif kind < 0.76:
                put(r.choice(("h2", "h3")), some(1, 8), True)
            elif kind < 0.84:
                html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    put("li", some(1, 15), True, r.random() < 0.1)
                html.append("</ul>")
            elif kind < 0.9:
                put("blockquote", prose(5, 40), True)
            elif kind < 0.93:
                put("figcaption", some(2, 15), True)
            else:
                boilerplate(r.choice(("ad", "related", "form", "share", "share")))
        html.append(f"</{tag}>")
        for kind in ("comments", "related", "form", "ad", "footer"):
            if r.random() < 0.55:
                boilerplate(kind)
        html.append("</body></html>")
        yield "".join(html), truth


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@functools.cache
def fit(n_pages: int = PAGES, seed: int = 7) -> Model:
    """Weights from ``n_pages`` labelled pages, and the cost of changes that mislabels the fewest blocks of half as many others."""
    pages = [(parse(html), truth) for html, truth in labelled_pages(n_pages, seed)]
    x = np.array([row for blocks, _ in pages for row in features(blocks)])
    y = np.array([t for _, truth in pages for t in truth], float)
    model = Model([float(w) for w in _fitted(x, y)])
    others = [(parse(html), truth) for html, truth in labelled_pages(n_pages // 2, seed + 1)]

    def wrong(smooth: float) -> int:
        return sum(a != b for blocks, truth in others for a, b in zip(labels(blocks, Model(model.weights, smooth)), truth, strict=True))

    model.smooth = min((0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0), key=wrong)
    return model


def main_text(html: str | None, model: Model | None = None) -> str:
    """Content blocks of a page in order, joined by two newlines."""
    if not html:
        return ""
    blocks = parse(html)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels(blocks, model or fit()), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h, shared.value) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    # nullable ids stay exact as strings in pandas
    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))
