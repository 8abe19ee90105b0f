"""Main text of web pages by minimum-cut labelling.

A page becomes a graph: a node for each text block, and one for each region, an element whose tag, role, class or id tells
content or boilerplate. A logistic classifier of a block's own text (words, links, sentence, heading, item) gives it the costs
of the two labels, which are its capacities to source and sink; it doesn't see where the block stands. A region's capacity is
its cue's, for each of its blocks. Smoothness edges tie a block to the region that it is in, regions to the regions around
them, blocks that follow each other (the more the nearer they are in the tree) and blocks of the same parent. The minimum cut, found
by maximum flow, labels all at once: what a page marks reaches its blocks through the edges only, and where it marks nothing
uncertain blocks follow their neighbours.

The classifier is fitted on blocks of a bounded sample of pages whose region tells their label. PRIOR is the mean of a Gaussian
prior, and stands where the sample says nothing. Forms and headers that hold most of a page's long blocks are wrappers: their
cue and the edges to it fade with that share.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, first_by_hash
from pagewright.operators.markup import CLOSE, OPEN, RAW, TEXT, attributes, tokens

SAMPLE_PAGES = 1500
BLOCKS_PER_PAGE = 40
#: Capacities of edges: blocks that follow each other, of the same parent, block and region, region and outer region.
SMOOTH, SIBLING, REGION, OUTER = 1.0, 0.2, 5.0, 1.0
#: What a block's text may count for, and each block of a region for its cue.
LIMIT = 3.5
GOOD, GOOD_WORD, BAD = 4.0, 1.5, -6.0
#: Words of a long block. Elements deeper than DEEPEST become siblings, as in browsers.
LONG = 15
DEEPEST = 256

#: Elements that end a block, whose text isn't text, that hold content or boilerplate; words of class and id.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul video audio".split()
)
VOID = frozenset("br hr".split())
RAWS = frozenset("script style noscript template title textarea svg iframe canvas object math".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer header aside form menu dialog button select fieldset search option label legend".split())
GOOD_WORDS = frozenset("article content contents entry main post story text body prose".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "discussion disqus disclaimer footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "popup privacy promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget widgets".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
WRAPPERS = frozenset("form header".split())
#: (feature, prior mean)
PRIOR = (("bias", -1.0), ("words", 1.0), ("links", -3.0), ("sentence", 1.0), ("heading", 0.5), ("item", -0.5), ("rights", -2.0))

_LETTERS = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NO_P = BLOCK - VOID - {"label", "button", "legend", "option"}


@dataclass
class Region:
    """cue: what each block of it counts; tag; the region around it."""

    cue: float
    tag: str
    outer: Region | None


@dataclass
class Element:
    tag: str
    depth: int
    parent: Element | None
    region: Region | None


@dataclass
class Block:
    element: Element
    text: list[str] = field(default_factory=list)
    link_chars: int = 0
    chars: int = 0


def _cue(tag: str, attrs: str) -> float:
    if tag in BAD_TAGS:
        return BAD
    found = GOOD if tag in GOOD_TAGS else 0.0
    if attrs and tag not in ("html", "body"):
        own = attributes(attrs)
        if set(own.get("role", "").lower().split()) & BAD_ROLES:
            return BAD
        words = {w.lower() for w in _LETTERS.findall(_CAMEL.sub(" ", own.get("class", "") + " " + own.get("id", "")))}
        if not found and words & BAD_WORDS:
            return BAD
        if not found and words & GOOD_WORDS:
            found = GOOD_WORD
    return found


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    region, cue = parent.region if parent is not None else None, _cue(tag, attrs)
    if cue:
        region = Region(cue, tag, region)
    return Element(tag, 0 if parent is None else parent.depth + 1, parent, region)


def blocks(page: str) -> list[tuple[Block, str]]:
    """The non-empty text blocks of a page, in order, with their text decoded and its white space collapsed.

    Open elements end where HTML ends them: a paragraph at the next block, an item at the next item; an end tag closes what
    is open inside its element; end tags of nothing and unfinished tags are left out.
    """
    here, out, link = _element("html", "", None), [], False
    now = Block(here)
    for kind, name, more in tokens(page, RAWS):
        if kind == TEXT:
            s = html.unescape(name) if "&" in name else name
            now.text.append(s)
            n = len(s.strip())
            now.chars += n
            now.link_chars += n * link
            continue
        if kind == RAW:
            continue
        if name not in BLOCK:
            if name == "a":
                link = kind == OPEN
            continue
        if now.text:
            out.append(now)
        link = False
        if kind == CLOSE:
            up = here
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
        elif name not in VOID and name not in ("html", "body"):
            if name in _NO_P and here.tag == "p":
                here = here.parent
            if here.tag in _CLOSES.get(name, ()):
                here = here.parent
            if here.depth == DEEPEST:
                here = here.parent
            here = _element(name, more, here)
        now = Block(here)
    out.append(now)
    found = ((b, " ".join("".join(b.text).split())) for b in out)
    return [(b, t) for b, t in found if t]


def features(b: Block, text: str) -> tuple[float, ...]:
    tag = b.element.tag
    return (
        1.0,
        math.log1p(text.count(" ") + 1) / 2,
        b.link_chars / max(1, b.chars),
        float(text[-1] in ".!?…\"'”»。！？" and len(text) > 20),
        float(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()),
        float(tag in ("li", "td", "th", "dt", "dd")),
        float("©" in text or "all rights reserved" in text.lower()),
    )


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights near PRIOR, by gradient descent."""
    prior = np.array([v for _, v in PRIOR])
    w = prior.copy()
    for _ in range(300 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (p - y) / len(x) + 0.02 * (w - prior))
    return w


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the sum of |gain| of nodes labelled against its sign and of the edges between different labels.

    Nodes whose gain outweighs all their edges are settled first, and count for their neighbours; the rest goes by connected
    component through a maximum flow by shortest augmenting paths.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:
            part, stack = {i}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j not in part:
                        part.add(j)
                        stack.append(j)
            content = _flow(sorted(part), gain, near)
            for j in part:
                label[j] = j in content
    return [bool(x) for x in label]


def _flow(part: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes on the source's side of a minimum cut: flow is sent by shortest paths, level by level."""
    source, sink = len(part), len(part) + 1
    number = {x: i for i, x in enumerate(part)}
    edges: list[list[int]] = [[] for _ in range(len(part) + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        edges[a].append(len(to))
        edges[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for x, i in number.items():
        if gain[x] > 0:
            join(source, i, gain[x], 0.0)
        else:
            join(i, sink, -gain[x], 0.0)
        for y, w in near[x].items():
            if number[y] > i:
                join(i, number[y], w, w)
    while True:
        level = [-1] * len(edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in edges[i]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {x for x, i in number.items() if level[i] >= 0}
        at = [0] * len(edges)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                here = to[path[full] ^ 1]
                del path[full:]
                continue
            own = edges[here]
            while at[here] < len(own) and not (room[own[at[here]]] > 1e-9 and level[to[own[at[here]]]] == level[here] + 1):
                at[here] += 1
            if at[here] < len(own):
                path.append(own[at[here]])
                here = to[path[-1]]
            elif path:
                here = to[path.pop() ^ 1]
                at[here] += 1
            else:
                break


def _closeness(a: Element, b: Element) -> float:
    """1 for the same element and for children of one; less by the square of the steps between them in the tree."""
    steps = 0
    while a is not b:
        steps += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return 1 / max(1, steps - 1) ** 2


def graph(found: list[tuple[Block, str]], weights: np.ndarray) -> tuple[list[float], dict[tuple[int, int], float]]:
    """(gain of being content, capacities of edges) of the blocks, then the regions."""
    w = weights.tolist()
    gain = [max(-LIMIT, min(LIMIT, sum(p * q for p, q in zip(w, features(b, t), strict=True)))) for b, t in found]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    number: dict[int, int] = {}
    held: list[list] = []  # regions, their blocks, the long ones of all inside
    inside: list[tuple[int, int]] = []
    long_blocks = 0

    def node(region: Region) -> int:
        """The region's number; those around it get theirs, too."""
        first = None
        inner = None
        while region is not None:
            i = number.get(id(region))
            new = i is None
            if new:
                i = number[id(region)] = len(held)
                held.append([region, 0, 0])
            first = i if first is None else first
            if inner is not None:
                edges[len(found) + inner, len(found) + i] = OUTER
            if not new:
                break
            inner, region = i, region.outer
        return first

    for i, (b, t) in enumerate(found):
        if i:
            edges[i - 1, i] = SMOOTH * _closeness(found[i - 1][0].element, b.element)
        parent = id(b.element.parent)
        if parent in last:
            edges[last[parent], i] = edges.get((last[parent], i), 0) + SIBLING
        last[parent] = i
        is_long = t.count(" ") + 1 >= LONG
        long_blocks += is_long
        if b.element.region is not None:
            r = node(b.element.region)
            inside.append((i, r))
            held[r][1] += 1
            up = b.element.region
            while is_long and up is not None:
                held[number[id(up)]][2] += 1
                up = up.outer
    weight = [1 - many / long_blocks if region.tag in WRAPPERS and long_blocks else 1.0 for region, _, many in held]
    for i, r in inside:
        edges[i, len(found) + r] = REGION * weight[r]
    return gain + [region.cue * n * v for (region, n, _), v in zip(held, weight, strict=True)], edges


def extract(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by one space; empty if there are none, or the page is null."""
    found = blocks(page or "")
    kept = min_cut(*graph(found, weights))
    return " ".join(t for (_, t), keep in zip(found, kept, strict=False) if keep)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for page in batch.column(0).to_pylist():
            rows = []
            for b, t in blocks(page or ""):
                cue = b.element.region.cue if b.element.region else 0
                if cue in (GOOD, BAD):
                    rows.append((zlib.crc32(t.encode("utf-8", "surrogatepass")), (*features(b, t), float(cue > 0))))
            made.append(np.array([r for _, r in sorted(rows)[:BLOCKS_PER_PAGE]], np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["x", "page_id"])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from at most BLOCKS_PER_PAGE blocks of each of `sample` pages, those with the least hash of page_id."""
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    ids = first_by_hash(own.where("page_id IS NOT NULL"), "page_id", sample)
    made = own.join(F.broadcast(ids), "page_id", "left_semi").select("html", "page_id").mapInArrow(_labelled, "x binary, page_id long")
    rows = made.groupBy("page_id").agg(F.min("x").alias("x")).collect()  # one row of an id that repeats
    x = np.frombuffer(b"".join(sorted(bytes(r.x) for r in rows)), np.float32).reshape(-1, len(PRIOR) + 1).astype(float)
    return fit(x[:, :-1], x[:, -1])


def main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html, ...).

    A null page counts as empty. Rows that repeat stay; an empty table gives none.
    """
    bounded_batches(pages.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(find, "page_id long, url string, text string, n_chars long")


def extraction(pages: DataFrame) -> DataFrame:
    """main_text of pages with weights fitted on a sample of them; without rows to fit on PRIOR stands. Cases as in main_text."""
    return main_text(pages, train(pages))
