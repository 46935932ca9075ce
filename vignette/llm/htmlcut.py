"""Operator 9: HTML extraction by minimum-cut labelling.

A page becomes blocks of text, each with its place in the DOM. A logistic classifier turns a block's features into the
cost of calling it content and the cost of calling it boilerplate; these are the capacities to the two terminals of a
flow network. Blocks that follow each other, and blocks near each other in the DOM (children of one element), are
joined by edges whose capacity is the cost of labelling them differently. The maximum flow's cut is the labelling of
least total cost. The classifier is trained here, on blocks of SAMPLE_PAGES pages at most whose elements tell what they
are (article and main against nav, header, footer, aside and advertisements); it sees neither these elements nor
their class names, so that it serves pages without them.

Cases: null or empty html gives null or empty text and no blocks; text without any element is one block; unclosed and
crossing elements are closed by their ancestors, noscript, svg and template too; a head without its end tag ends at
the body, the first text or the first element that is not metadata; script, style and comments without an end reach to
the end of the page, as in HTML; a tag without its > is text; ties of the cut go to boilerplate; a page of any length and
depth is read whole, in linear time; repeated rows get equal results; an empty table gives no rows; without telling
elements in the sample a fixed prior replaces the classifier; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE_PAGES = 500
ADJACENT = 1.0  # capacity between blocks that follow each other under one parent; less with distance in the DOM
SIBLING = 0.6  # between a block and the one before it under the same parent, other blocks between them

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<title\b[^>]*>((?:(?!</?head\b|<body\b|<title\b).)*?)</title\s*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
_BREAKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # all others end the head
_HIDDEN = frozenset(["noscript", "svg", "template"])
_LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong sub sup table u ul var".split())
_CONTENT, _BOILER = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "header"])
_AD = re.compile(r"\b(?:ads?|advert\w*|promo\w*|sponsor\w*|banner|sidebar|cookie\w*|breadcrumb\w*|menu|navigation)\b", re.I)
_LEAVES = frozenset("p li td th h1 h2 h3 h4 h5 h6 dd dt".split())  # blocks of these lie in what holds them
_ALIKE = frozenset("p li td th tr dd dt option".split())  # a new one closes one that is open
FEATURES = 14


_TITLE = re.compile(r"<title\b[^>]*>((?:(?!</?head\b|<body\b|<title\b).)*?)</title\s*>", re.S | re.I)
_QUOTES = re.compile("[\"'>]")
_NAME = re.compile(r"</?[a-zA-Z][\w:-]*")


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """(places of the signs " ' >, for each the place of the > that ends a tag which is open and outside quotes there, -1
    for none). One pass from the end, so that a page of tags without an end costs no more than any other."""
    at = [m.start() for m in _QUOTES.finditer(html)]
    ends = [-1] * len(at)
    out = single = double = -1
    for k in range(len(at) - 1, -1, -1):
        sign = html[at[k]]
        if sign == ">":
            out = at[k]
        elif sign == '"':
            out, double = double, out
        else:
            out, single = single, out
        ends[k] = out
    return at, ends


def _tokens(html: str):
    """(title, text, name, "/" of an end tag, attributes) of every token; comments and the like give None throughout.
    Patterns read the page until one of them runs into a tag without an end; from there on ends are looked up."""
    start = 0
    for m in _TOKEN.finditer(html):
        if m[6] == "<" and (after := html[m.start() + 1 : m.start() + 2]) and (after in "/!?" or after.isalpha()):
            start = m.start()
            break
        yield m[2], m[6], m[4], m[3], m[5]
    else:
        return
    at, ends = _tag_ends(html)
    last, close, failed = html.rfind(">"), -1, -1  # of the page; the next one; the one behind which no title ends
    while start < len(html):
        if html[start] != "<":
            stop = html.find("<", start)
            stop = len(html) if stop < 0 else stop
            yield None, html[start:stop], None, None, None
            start = stop
            continue
        m = found = None
        if html.startswith("<!--", start) or start < last and html[start + 1] in "!?":
            found = _TOKEN.match(html, start)
        elif start < last and (m := _NAME.match(html, start)):
            name = m[0][1:].lower()
            if name in ("script", "style"):
                found = _TOKEN.match(html, start)
            elif name == "title":
                close = html.find(">", start) if close < start else close
                if close != failed and not (found := _TITLE.match(html, start)):
                    failed = close
        if found:
            yield (found[2] if found.re is _TOKEN else found[1]), None, None, None, None
            start = found.end()
            continue
        k = bisect_left(at, m.end()) if m else len(at)
        stop = ends[k] if k < len(at) else -1
        if stop < 0:
            yield None, "<", None, None, None
            start += 1
        else:
            yield None, None, m[0].lstrip("</"), "/" if m[0][1] == "/" else "", html[m.end() : stop]
            start = stop + 1


class Block:
    __slots__ = ("text", "linked", "tag", "depth", "parent", "node", "hint")

    def __init__(self, text: str, linked: int, tag: str, node: "Node", hint: int):
        self.text, self.linked, self.tag, self.node, self.hint = text, linked, tag, node, hint
        self.depth, self.parent = node.depth, node.number


class Node:
    """An element that blocks lie in; 0 is the page."""

    __slots__ = ("number", "depth", "up")

    def __init__(self, number: int, up: "Node | None"):
        self.number, self.up = number, up
        self.depth = 0 if up is None else up.depth + 1


def apart(a: Node, b: Node) -> int:
    """Steps between two elements. Over the blocks of a page in order they add up to twice its elements at most."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, in time linear in its length. hint: 1 in article or main, -1 in boilerplate elements,
    else 0; for training only."""
    out: list[Block] = []
    root = Node(0, None)
    stack: list[tuple[str, Node, int]] = []  # block elements: (tag, node, hint)
    opened: dict[str, int] = {}  # how many of each tag are in the stack
    text: list[str] = []
    linked = links = serial = 0
    head = titled = False  # in the head; after a title in it that is not closed
    inner: list[str] = []  # open elements from a hidden one on
    within: dict[str, int] = {}  # how many of each tag are in it
    inline: dict[str, int] = {}  # open elements that are not in the stack

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                tag, node, hint = stack[-1] if stack else ("", root, 0)
                out.append(Block(joined, min(linked, len(joined)), tag, node.up if tag in _LEAVES else node, hint))
            text.clear()
        linked = 0

    for title, plain, tag, closing, more in _tokens(html):
        words = title if title is not None else plain
        if words is not None:
            if head and (title is not None or titled or not words.strip()) or inner:
                continue
            head = False
            text.append(words)
            if links:
                linked += len(words.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if inner:
            if closing:
                if within.get(tag):
                    while True:
                        gone = inner.pop()
                        within[gone] -= 1
                        if gone == tag:
                            break
                    continue
                if not (inline.get(tag) or head and tag == "head" or opened.get(tag)):
                    continue
                inner.clear()
                within.clear()
            elif head and tag == "body" or tag in _LEAVES_SVG and inner[0] == "svg" and not any(within.get(x) for x in ("foreignobject", "desc", "title")):
                inner.clear()
                within.clear()
            else:
                if tag not in _VOID and not more.endswith("/"):
                    inner.append(tag)
                    within[tag] = within.get(tag, 0) + 1
                continue
        if tag == "head":
            head, titled = not closing, False
            continue
        if head:
            titled = tag == "title" and not closing
            head = tag in _HEAD or bool(closing) and tag not in ("body", "html", "br")
        if tag in _HIDDEN and not closing:
            if not (tag == "svg" and more.endswith("/")):
                inner.append(tag)
                within[tag] = 1
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag not in _BREAKS:
            if tag not in _VOID:
                inline[tag] = max(0, inline.get(tag, 0) + (-1 if closing else 1))
            continue
        flush()
        if tag in _VOID:
            continue
        if closing:
            if opened.get(tag):
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == tag:
                        break
            links = 0
            continue
        if tag in _ALIKE and stack and stack[-1][0] == tag:
            stack.pop()
            opened[tag] -= 1
        hint = stack[-1][2] if stack else 0
        if tag in _CONTENT:
            hint = 1
        elif tag in _BOILER:
            hint = -1
        elif more and (named := _CLASS.findall(more)) and _AD.search(" ".join(named)):
            hint = -1
        serial += 1
        stack.append((tag, Node(serial, stack[-1][1] if stack else root), hint))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    out = np.empty((len(page), FEATURES))
    lengths = [len(b.text) for b in page]
    for i, b in enumerate(page):
        n = lengths[i]
        words = b.text.count(" ") + 1
        stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
        around = (lengths[i - 1] if i else 0) + (lengths[i + 1] if i + 1 < len(page) else 0)
        out[i] = (1.0, min(np.log1p(n), 8) / 4, b.linked / n, min(words, 60) / 30, min(n / words, 15) / 8, min(stops, 6) / 3, b.tag == "p", b.tag == "li", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("td", "th"), b.tag in ("div", "section", ""), min(np.log1p(around), 9) / 4, "©" in b.text or "|" in b.text[:40] and n < 80, min(b.depth, 12) / 6)
    return out


#: Log odds of content without a trained classifier: long text with sentences and few links.
PRIOR = np.array([-2.0, 1.0, -3.0, 1.2, 0.0, 0.8, 0.6, -0.6, 0.6, -0.3, -0.3, 0.2, -1.5, 0.0])


def train(pages: list[str], rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Weights from the telling elements of the pages, by Newton steps; PRIOR if a class is missing."""
    x, y = [], []
    for text in pages:
        found = blocks(text)
        if not found:
            continue
        f = features(found)
        hints = np.array([b.hint for b in found])
        x.append(f[hints != 0])
        y.append(hints[hints != 0] > 0)
    if not x or len(set(np.concatenate(y).tolist())) < 2:
        return PRIOR
    x, y = np.concatenate(x), np.concatenate(y).astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        move = np.linalg.solve(x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + ridge * np.eye(FEATURES), grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, capacity), i < j: neighbours in the text and, further apart, under one parent."""
    out, seen = [], {}
    for j, b in enumerate(page):
        if j:
            out.append((j - 1, j, ADJACENT / (1 + apart(page[j - 1].node, b.node))))
        before = seen.get(b.parent)
        if before is not None and before != j - 1:
            out.append((before, j, SIBLING))
        seen[b.parent] = j
    return out


def cut(gain: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of the minimum cut. gain > 0 is the capacity from the source, < 0 to the
    sink; `joined` holds undirected edges. Dinic's algorithm; flow that needs no edge is already netted in `gain`."""
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            link(source, i, g, 0.0)
        elif g < 0:
            link(i, sink, -g, 0.0)
    for a, b, c in joined:
        link(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                back = 0
                for k, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                    if room[e] <= tiny and back == 0:
                        back = k + 1
                path = path[: back - 1]
                u = to[path[-1]] if path else source
                continue
            moved = False
            edges_u = out[u]
            while at[u] < len(edges_u):
                e = edges_u[at[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    moved = True
                    break
                at[u] += 1
            if moved:
                continue
            if not path:
                break
            e = path.pop()
            u = to[e ^ 1]
            at[u] += 1


def extract(html: str, weights: np.ndarray) -> tuple[str, int, int]:
    """(content, blocks, blocks of content)."""
    page = blocks(html)
    if not page:
        return "", 0, 0
    odds = np.clip(features(page) @ weights, -6, 6)
    content = cut(odds.tolist(), edges(page))
    kept = [b.text for b, c in zip(page, content) if c]
    return "\n".join(kept), len(page), len(kept)


def fit(pages: DataFrame, most: int = SAMPLE_PAGES) -> np.ndarray:
    """Learns from the `most` pages that come first by a hash. Hashes alone find the bound, so that no task sends more
    pages than it has of these."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html <> ''").withColumn("hash", F.xxhash64("html"))
    bound = rows.select("hash").orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    rows = rows.where(F.col("hash") <= (0 if bound is None else bound)).orderBy("hash", "html").limit(most).collect()
    return train([r["html"] for r in rows])


def contents(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, content, blocks, content_blocks) of every row; no shuffle."""
    weights = fit(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            rows = [(None, 0, 0) if h is None else extract(h, weights) for h in batch.column(1).to_pylist()]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], ["page_id", "content", "blocks", "content_blocks"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, content string, blocks int, content_blocks int")
