"""Rules that read values from pages: selectors as data, evaluated for all rules in one pass over a page's tree.

A page is indexed once, by tag, class, id and attribute name; a rule looks its elements up by what its selector asks of the
element itself, and checks ancestors, from right to left, for those only. A rule finds elements below the page's root, narrows them, picks one and takes its value. Which rule of a field wins, what is
recorded and why a page is refused is decided later, on columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from pagewright.operators.blocks import BLOCK, walk
from pagewright.operators.nodes import bounded_batches, normal, parse, pieces
from pagewright.operators.selectors import Compound, compiled, keys_of, passes

FACT = "struct<matched:int,value:string,pre:int,last:int,level:int>"

Node = dict


@dataclass(frozen=True)
class Rule:
    """selector: `,` separates alternatives; `{name}` stands for a parameter of the page.

    scope: `root` or `document`. outside: no element this matches may hold the found one, or be it. after: only elements that
    follow what that rule found, if it found any. contains: text that must occur. equals: parameter that the normalised text
    equals. sub: the value is of the first such element inside. pick: first, longest (of several the first), text (the first with
    text), or word (the first whose normalised text is one of words). attr: the value is that attribute; else normalised text,
    null if empty. pattern: the value is the pattern's first group in it.
    """

    name: str
    selector: str
    scope: str = "root"
    outside: str | None = None
    after: str | None = None
    contains: str | None = None
    equals: str | None = None
    sub: str | None = None
    pick: str = "first"
    words: tuple[str, ...] = ()
    attr: str | None = None
    pattern: str | None = None


_INK = re.compile(r"[^\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")


def ink(text: str) -> int:
    """Characters that aren't white space: as many before normalising as after."""
    return sum(map(len, _INK.findall(text)))


def lies_in(at: int, spans: tuple[list[int], list[int]], below: bool = False) -> bool:
    """Whether a node is in one of the spans, which don't overlap; below: not as the first of it."""
    k = (bisect_left if below else bisect_right)(spans[0], at) - 1
    return k >= 0 and at <= spans[1][k]


class Page:
    """A page's nodes under an index: elements by tag, class, id and attribute, text by where it lies in the page's whole text."""

    def __init__(self, nodes: list[Node], params: dict[str, str]):
        self.nodes, self.params, self.root = nodes, params, -1
        self.found: dict[str, int | None] = {}
        self.by: dict[tuple[str, str], list[int]] = {}
        self.known: dict[str, list[int]] = {}  # what a selector finds in the whole page
        self.spans: dict[str, tuple[list[int], list[int]]] = {}  # the outermost finds of a selector: first and last node
        starts, inks, parts, at, dark = [], [], [], 0, 0
        for i, n in enumerate(nodes):
            starts.append(at)
            inks.append(dark)
            if n["tag"] is None:
                parts.append(n["text"])
                at += len(n["text"])
                dark += ink(n["text"])
                continue
            n["map"] = own = n.get("map") or dict(n["attrs"])
            for key in keys_of(n["tag"], own):
                self.by.setdefault(key, []).append(i)
        self.starts, self.inks, self.whole = [*starts, at], [*inks, dark], "".join(parts)

    def last(self, at: int) -> int:
        return self.nodes[at]["last"] if at >= 0 else len(self.nodes) - 1

    def text(self, at: int) -> str:
        return self.whole[self.starts[at + 1] : self.starts[self.last(at) + 1]]

    def length(self, at: int) -> int:
        return self.starts[self.last(at) + 1] - self.starts[at + 1]

    def ink(self, at: int) -> int:
        return self.inks[self.last(at) + 1] - self.inks[at + 1]

    def candidates(self, compound: Compound) -> Sequence[int]:
        """The shortest list of the index that holds all elements of a compound."""
        lists = [self.by.get(key, ()) for key in compound.keys()]
        return min(lists, key=len) if lists else [i for i, n in enumerate(self.nodes) if n["tag"] is not None]

    def outermost(self, found: Sequence[int]) -> tuple[list[int], list[int]]:
        """(first, last) nodes of those that lie in no other one."""
        firsts: list[int] = []
        for i in found:
            if not firsts or i > self.nodes[firsts[-1]]["last"]:
                firsts.append(i)
        return firsts, [self.nodes[i]["last"] for i in firsts]

    def chained(self, chain: Sequence[Compound]) -> list[int]:
        """The elements of the last compound below some of the one before, and so on; from the left, each by the spans of the one before."""
        found: list[int] | None = None
        for compound in chain:
            spans = self.outermost(found) if found is not None else None
            own = self.candidates(compound)
            if spans is not None:
                own = [i for i in own if lies_in(i, spans, below=True)]
            found = [i for i in own if passes(compound, self.nodes[i]["tag"], self.nodes[i]["map"], self.params)]
        return found or []

    def every(self, selector: str) -> list[int]:
        """All elements of the page that a selector finds, in order; looked up once a page."""
        if selector not in self.known:
            hits = [self.chained(chain) for chain in compiled(selector)]
            self.known[selector] = hits[0] if len(hits) == 1 else sorted(set().union(*hits))
        return self.known[selector]

    def all(self, selector: str, root: int) -> list[int]:
        found = self.every(selector)
        return found[bisect_right(found, root) : bisect_right(found, self.last(root))]

    def covered(self, at: int, selector: str) -> bool:
        """Whether the selector finds the element or one around it: whether it lies in one of the outermost finds."""
        if selector not in self.spans:
            self.spans[selector] = self.outermost(self.every(selector))
        return lies_in(at, self.spans[selector])

    def contains(self, at: int, text: str) -> bool:
        return self.whole.find(text, self.starts[at + 1], self.starts[self.last(at) + 1]) >= 0

    def reading(self, at: Sequence[int], texts: Sequence[str]) -> Iterator[int]:
        """Those whose normalised text is one of texts; only texts with as much ink are looked at."""
        inks = {ink(t) for t in texts}
        return (i for i in at if self.ink(i) in inks and normal(self.text(i)) in texts)


def apply(rule: Rule, page: Page) -> tuple[int, str | None, int | None]:
    """(elements matched, value, element): what a rule finds on a page."""
    at = page.all(rule.selector, page.root if rule.scope == "root" else -1)
    if rule.outside:
        at = [i for i in at if not page.covered(i, rule.outside)]
    if rule.after and page.found.get(rule.after) is not None:
        at = [i for i in at if i > page.found[rule.after]]
    if rule.contains:
        at = [i for i in at if page.contains(i, rule.contains)]
    if rule.equals is not None:
        wanted = page.params[rule.equals]
        at = list(page.reading(at, (wanted,))) if wanted else []
    if rule.pick == "text":
        chosen = next((i for i in at if page.ink(i)), None)
    elif rule.pick == "word":
        chosen = next(page.reading(at, rule.words), None)
    elif rule.pick == "longest":
        chosen = max(at, key=lambda i: (page.length(i), -i), default=None)
    else:
        chosen = at[0] if at else None
    page.found[rule.name] = chosen
    if chosen is None:
        return len(at), None, None
    source = chosen if rule.sub is None else next(iter(page.all(rule.sub, chosen)), None)
    if source is None:
        return len(at), None, chosen
    value = page.nodes[source]["map"].get(rule.attr) if rule.attr else normal(page.text(source)) or None
    if rule.pattern and rule.pick == "text":  # the first element in whose text the pattern is found
        value = next((m[1] for m in (re.search(rule.pattern, page.text(i)) for i in at) if m), None)
    elif rule.pattern and value is not None:
        m = re.search(rule.pattern, value)
        value = m[1] if m else None
    return len(at), value, chosen


def root_of(page: Page, selectors: Sequence[str], ancestor_of: str | None) -> int:
    """The first element of the first selector that has one, else the nearest common ancestor of ancestor_of's, else the page."""
    for s in selectors:
        if found := page.all(s, -1):
            return found[0]
    paths = [page.nodes[i]["path"] for i in page.all(ancestor_of, -1)] if ancestor_of else []
    shared = set(paths[0]).intersection(*paths[1:]) if paths else set()
    return max(shared, default=-1)


def read(
    pages: DataFrame,
    rules: Sequence[Rule],
    roots: Sequence[str] = (),
    ancestor_of: str | None = None,
    params: Sequence[str] = (),
    scripts: str | None = None,
    walks: dict[str, Sequence[str]] | None = None,
    xml: bool = False,
    closed: bool = False,
) -> DataFrame:
    """pages (html, ...) with `facts` (rule name to FACT), `scripts` (texts of the elements of that selector) and `walked`, in place of html.

    params: string columns that selectors and rules refer to, null as empty. walks: for each name the rules whose first find is
    the element that is walked; walked holds its blocks under that name, none for an element without text, null without an
    element. All in one pass over the page, which is parsed once; a page whose html is null has no elements. closed: as in `parse`.
    """
    kept = [c for c in pages.columns if c != "html"]
    added = [("facts", f"map<string,{FACT}>"), ("scripts", "array<string>"), ("walked", f"map<string,array<{BLOCK}>>")]
    schema = StructType([*pages.select(*kept).schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in added)])
    fact = pa.struct([("matched", pa.int32()), ("value", pa.string()), ("pre", pa.int32()), ("last", pa.int32()), ("level", pa.int32())])
    block = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("depth", pa.int32())]))
    rules, roots, params, walks = tuple(rules), tuple(roots), tuple(params), dict(walks or {})
    bounded_batches(pages.sparkSession)

    def one(html: str | None, values: dict[str, str]):
        nodes = parse(html or "", xml, closed)
        page = Page(nodes, values)
        page.root = root_of(page, roots, ancestor_of)
        facts = []
        for rule in rules:
            n, value, at = apply(rule, page)
            facts.append((rule.name, {"matched": n, "value": value} | {k: None if at is None else nodes[at][k] for k in ("pre", "last", "level")}))
        walked = []
        for name, ordered in walks.items():
            at = next((page.found[r] for r in ordered if page.found[r] is not None), None)
            if at is not None:
                walked.append((name, walk(nodes, at)))
        return facts, [page.text(i) for i in page.all(scripts, -1)] if scripts else [], walked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            table = batch.to_pydict()
            made = [one(table["html"][i], {p: table[p][i] or "" for p in params}) for i in range(batch.num_rows)]
            facts, scripts_, walked = zip(*made, strict=True) if made else ((), (), ())
            cols = [pa.array(facts, pa.map_(pa.string(), fact)), pa.array(scripts_, pa.list_(pa.string())), pa.array(walked, pa.map_(pa.string(), block))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *cols], names=schema.names)

    return pages.select(*kept, F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
