"""HTML extraction: the main text of a page by a graphical model on its DOM tree.

Every element and every run of text is a node that is content or not.  A node has a potential from what is
seen of it (tag, names in class, id and role, text and link lengths), an edge one for each pair of labels
of parent and child.  Sum-product messages go up from the leaves and down from the root and give each
node's marginal.  Weights are trained by the likelihood of labelled pages, whose gradient is the difference
of observed and expected features under the same messages.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import shipped, whole
from loglattice.llm.html_labelled import labelled_pages

#: Possessive, so that a tag that never ends is given up after one pass over it.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
NAMES = re.compile(r"(?:^|\s)(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea select iframe noframes".split())
#: Their contents are text, whatever marks it holds.
LITERAL = frozenset(("xmp", "listing", "plaintext"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "dd", "dt", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"dd", "dt"}
#: An element of a group ends an open one of the group, up to the element that holds them.
SIBLINGS = (
    (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    (frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("td", "th")), frozenset(("tr", "table"))),
    (frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot"))),
    (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    (frozenset(("option",)), frozenset(("select",))),
)

#: Kinds of elements, and of names in class, id and role.
TAG_KINDS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button label legend",
    "main": "article main", "p": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd",
    "table": "table tr td th tbody thead tfoot", "box": "div section figure figcaption", "link": "a", "root": "html body",
}
NAME_KINDS = {
    "ad": "ad ads adv advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sponsors",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs",
    "comment": "comment comments reply replies respond discussion disqus feedback",
    "foot": "footer foot copyright contentinfo colophon legal",
    "head": "header masthead topbar banner logo",
    "side": "sidebar side aside widget widgets related recommended complementary rail more",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe subscription signup disclaimer",
    "social": "share sharing social follow tags meta byline",
    "content": "article content post entry story main body text",
    "form": "form search login",
}
_TAG = {t: k for k, ts in TAG_KINDS.items() for t in ts.split()}
_NAME: dict[str, list[str]] = {}
for _k, _ns in NAME_KINDS.items():
    for _n in _ns.split():
        _NAME.setdefault(_n, []).append(_k)


@dataclass(slots=True)
class Node:
    """An element, or a run of text (tag '')."""

    tag: str
    parent: int
    names: frozenset[str] = frozenset()
    text: str = ""
    label: str = ""
    chars: int = 0
    linked: int = 0
    stops: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: Numbers of text nodes, block by block.
    blocks: list[list[int]] = field(default_factory=list)


class _Open:
    """The open elements, and for each tag the places where it is open."""

    def __init__(self):
        self.nodes = [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


_CELL = frozenset(("td", "th", "table"))
_IN_TABLES = frozenset(("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html"))
_P = frozenset(("p",))
#: What a paragraph that is open outside does not end in.
_SCOPE = frozenset(("button", "table", "td", "th", "caption"))


class _Ends:
    """Where raw elements end; a tag without an end further on is looked for once."""

    def __init__(self, source: str):
        self.source, self.missing = source, set()

    def after(self, tag: str, at: int) -> re.Match | None:
        if tag in self.missing:
            return None
        found = _end_of(tag).search(self.source, at)
        if found is None:
            self.missing.add(tag)
        return found


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I)


def parse(source: str) -> Page:
    """DOM tree of tag soup, in document order: parents come before their children.

    Time grows with the length of the page, however deep, cut or unclosed its elements are.
    """
    page = Page([Node("html", -1)])
    nodes, open_, ends = page.nodes, _Open(), _Ends(source)
    block: list[int] = []
    links = 0

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def close(to: int) -> None:
        nonlocal links
        while len(open_.nodes) > to:
            tag = nodes[open_.nodes.pop()].tag
            open_.places[tag].pop()
            links -= tag == "a"
            if tag in BLOCK:
                flush()

    def text(raw: str, literal: bool = False) -> None:
        if not raw:
            return
        if "&" in raw and not literal:
            raw = html.unescape(raw)
        n = len(raw.strip())
        block.append(len(nodes))
        stops = raw.count(".") + raw.count(",") + raw.count("!") + raw.count("?")
        nodes.append(Node("", open_.nodes[-1], text=raw, chars=n, linked=n if links else 0, stops=stops if n else 0))

    at, size = 0, len(source)
    last = source.rfind(">")
    while at < size:
        m = TOKEN.search(source, at) if at <= last else None
        if m is None:
            # behind the last tag there is text, up to a comment that nothing ends
            text(source[at:].partition("<!--")[0])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
                continue
            i = open_.innermost(frozenset((tag,)))
            if i and (tag in _IN_TABLES or i > open_.innermost(_CELL)):
                close(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = ends.after(tag, at)
                at = end.end() if end else size if tag in ("script", "style") else at
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in CLOSES_P and (i := open_.innermost(_P)) > open_.innermost(_SCOPE):
            close(i)
        for group, holder in SIBLINGS:
            if tag in group and (i := open_.innermost(group)) and i >= open_.innermost(holder):
                close(i)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        names, label = frozenset(), ""
        if "=" in m[3]:
            found = [(k.lower(), a or b or c) for k, a, b, c in NAMES.findall(m[3])]
            names = frozenset(w for k, v in found if k != "y" for w in WORD.findall(v.lower()))
            label = next((v for k, v in found if k == "y"), "")
        if tag in ("html", "body"):
            if nodes[0].tag == "html":
                nodes[0].names |= names if tag == "body" else frozenset()
                nodes[0].label = nodes[0].label or label
            continue
        links += tag == "a"
        nodes.append(Node(tag, open_.nodes[-1], names, label=label))
        open_.push(len(nodes) - 1, tag)
        if tag in LITERAL:
            end = ends.after(tag, at)
            text(source[at : end.start() if end else size], literal=True)
            at = end.end() if end else size
            close(len(open_.nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        n, up = nodes[i], nodes[nodes[i].parent]
        up.chars += n.chars
        up.linked += n.linked
        up.stops += n.stops
    return page


_TAG_AT = {k: i for i, k in enumerate([*TAG_KINDS, "other"])}
_NAME_AT = {k: len(_TAG_AT) + i for i, k in enumerate(NAME_KINDS)}
_SIZE_AT = len(_TAG_AT) + len(_NAME_AT)
_LINK_AT, _STOP_AT = _SIZE_AT + 6, _SIZE_AT + 10
_TEXT_AT = _STOP_AT + 3
FEATURES = _TEXT_AT + 13
KINDS = 4  # of edges: to text, to an inline element, to a block, to a block whose tag or name says it is none
_MARKED = frozenset(("nav", "header", "footer", "aside", "form"))
_PLAIN_NAMES = frozenset(("content",))


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Features that each node has, and the kind of the edge above it."""
    seen: list[list[int]] = []
    kinds: list[int] = []
    for n in page.nodes:
        size = 0 if n.chars == 0 else 1 if n.chars < 20 else 2 if n.chars < 60 else 3 if n.chars < 200 else 4 if n.chars < 800 else 5
        share = n.linked / n.chars if n.chars else 0.0
        link = 0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3
        stop = 0 if not n.stops else 1 if n.stops < 3 else 2
        if not n.tag:
            seen.append([_TEXT_AT + size, _TEXT_AT + 6 + link, _TEXT_AT + 10 + stop])
            kinds.append(0)
            continue
        kind = _TAG.get(n.tag, "other")
        own = {k for w in n.names for k in _NAME.get(w, ())}
        seen.append([_TAG_AT[kind], *[_NAME_AT[k] for k in own], _SIZE_AT + size, _LINK_AT + link, _STOP_AT + stop])
        kinds.append(1 if n.tag not in BLOCK else 3 if kind in _MARKED or own - _PLAIN_NAMES else 2)
    return seen, kinds


@dataclass(frozen=True)
class Model:
    """Weights of content against not, and edge weights by kind for child labels (0, 1) under parent labels (0, 1)."""

    node: tuple[float, ...]
    edge: tuple[tuple[float, ...], ...]


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def messages(parents: list[int], unary: list[float], edges: list[tuple[float, ...]], kinds: list[int]) -> tuple[list[float], list, list]:
    """Log-odds of content of each node by sum-product; the messages up and down, for edge marginals."""
    n = len(parents)
    zero, one = [0.0] * n, list(unary)
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        e, p = edges[kinds[i]], parents[i]
        m0, m1 = _log_add(zero[i] + e[0], one[i] + e[1]), _log_add(zero[i] + e[2], one[i] + e[3])
        up[i] = (m0, m1)
        zero[p] += m0
        one[p] += m1
    down: list[tuple[float, float]] = [(0.0, 0.0)] * n
    odds = [one[0] - zero[0]] + [0.0] * (n - 1)
    full = [(zero[0], one[0])] + [(0.0, 0.0)] * (n - 1)
    for i in range(1, n):
        e, p = edges[kinds[i]], parents[i]
        a, b = full[p][0] - up[i][0], full[p][1] - up[i][1]
        top = a if a > b else b
        a, b = a - top, b - top
        down[i] = (a, b)
        d0, d1 = _log_add(a + e[0], b + e[2]), _log_add(a + e[1], b + e[3])
        full[i] = (zero[i] + d0, one[i] + d1)
        odds[i] = full[i][1] - full[i][0]
    return odds, down, [zero, one]


def labels(page: Page) -> list[int]:
    """Labels of a marked page: text by the nearest mark above it, elements by most of their text."""
    mark = []
    for n in page.nodes:
        mark.append(n.label == "1" if n.label else mark[n.parent] if n.parent >= 0 else False)
    good = [n.chars if not n.tag and mark[i] else 0 for i, n in enumerate(page.nodes)]
    for i in range(len(page.nodes) - 1, 0, -1):
        good[page.nodes[i].parent] += good[i]
    return [int(mark[i]) if not n.tag or not n.chars else int(2 * good[i] > n.chars) for i, n in enumerate(page.nodes)]


def fit(pages: list[str], rounds: int = 120, rate: float = 0.15, l2: float = 0.02) -> Model:
    """Maximum likelihood by Adam; the gradient needs one pass of messages over each page."""
    data = []
    for source in pages:
        page = parse(source)
        seen, kinds = features(page)
        data.append((seen, kinds, [n.parent for n in page.nodes], labels(page)))
    w = np.zeros(FEATURES + 4 * KINDS)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for r in range(1, rounds + 1):
        grad = -l2 * w
        node, edge = w[:FEATURES].tolist(), [tuple(w[FEATURES + 4 * k : FEATURES + 4 * k + 4]) for k in range(KINDS)]
        for seen, kinds, parents, truth in data:
            unary = [sum(node[f] for f in s) for s in seen]
            odds, down, (zero, one) = messages(parents, unary, edge, kinds)
            for i, s in enumerate(seen):
                miss = truth[i] - 1 / (1 + math.exp(-max(-500, min(500, odds[i]))))
                for f in s:
                    grad[f] += miss
                if i:
                    e = edge[kinds[i]]
                    pair = [down[i][c >> 1] + e[c] + (one[i] if c & 1 else zero[i]) for c in range(4)]
                    top = max(pair)
                    pair = [math.exp(x - top) for x in pair]
                    total = sum(pair)
                    base = FEATURES + 4 * kinds[i]
                    for c in range(4):
                        grad[base + c] -= pair[c] / total
                    grad[base + 2 * truth[parents[i]] + truth[i]] += 1
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w + rate * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    return Model(tuple(w[:FEATURES].tolist()), tuple(tuple(w[FEATURES + 4 * k : FEATURES + 4 * k + 4].tolist()) for k in range(KINDS)))


@functools.cache
def trained() -> Model:
    return fit(labelled_pages())


def extract(source: str, model: Model, threshold: float = 0.5) -> str:
    """Main text: the text nodes with a marginal of at least ``threshold``, block by block."""
    page = parse(source)
    seen, kinds = features(page)
    node = model.node
    odds, _, _ = messages([n.parent for n in page.nodes], [sum([node[f] for f in s]) for s in seen], model.edge, kinds)
    least = math.log(threshold / (1 - threshold))
    out = []
    for block in page.blocks:
        kept = [page.nodes[i].text for i in block if odds[i] >= least or not page.nodes[i].chars]
        line = " ".join("".join(kept).split())
        if line:
            out.append(line)
    return "\n".join(out)


def extract_pages(pages: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) as page_id, url, text, n_chars.

    A null or empty page has the empty text; broken and cut markup is read as far as it goes; repeated rows
    stay, and other columns do not matter.  A page without an article may have the empty text.
    """
    used = model or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h, used, threshold) for h in b["html"]]
            ids = b["page_id"].astype("Int64")
            yield pd.DataFrame({"page_id": ids, "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = shipped(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
