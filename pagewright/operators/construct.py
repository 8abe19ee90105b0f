"""A page's tree built from its tags as HTML builds it: elements end where others begin, formatting that is closed out of order is
reopened, and what has no place in a table goes before it. XML is built as it is nested.

Not built: elements that a page leaves out (html, head, body, tbody, and rows around loose cells), and frames. Of formatting
elements that are open at once, the last FORMATTING are reopened.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

from pagewright.operators.markup import CLOSE, RAW, TEXT, attributes, tokens

#: Elements deeper than this become siblings, as in browsers: so a node's path is of bounded length.
DEEPEST = 256
FORMATTING = 32
#: Elements without content, of plain text, that format, that end a paragraph, that hold others' ends back, and that bound scopes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PLAIN = frozenset("script style textarea title".split())
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = ENDS_P | frozenset(
    "applet area base body br button caption col colgroup dd dt embed frame frameset head html iframe img input li link marquee meta noembed noframes noscript object script select source style tbody td template textarea tfoot th thead title tr track wbr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE, SELECT_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template")), frozenset(("html", "select", "template"))
MARKERS = frozenset("applet caption marquee object td template th".split())
SECTIONS, CELLS, COLUMNS = frozenset(("tbody", "thead", "tfoot")), frozenset(("td", "th")), frozenset(("caption", "colgroup"))
IN_TABLE = frozenset(("table", "tr")) | SECTIONS
STAYS_IN_TABLE = frozenset(("script", "style", "template"))
#: What an element ends when it begins, and how far that is looked for.
ENDS = {"li": (("li",), LIST_SCOPE), "dt": (("dt", "dd"), SCOPE), "dd": (("dt", "dd"), SCOPE), "option": (("option",), SELECT_SCOPE), "optgroup": (("option", "optgroup"), SELECT_SCOPE), "button": (("button",), SCOPE)}


class Node:
    """An element, or a text if it has no tag."""

    __slots__ = ("tag", "attrs", "text", "parent", "kids")

    def __init__(self, tag: str | None, attrs: list[tuple[str, str]], text: str | None = None):
        self.tag, self.attrs, self.text = tag, attrs, text
        self.parent: Node | None = None
        self.kids: list[Node] = []

    def again(self) -> Node:
        return Node(self.tag, self.attrs)

    def append(self, kid: Node) -> None:
        kid.parent = self
        self.kids.append(kid)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.kids.pop(position(self.parent.kids, self))
            self.parent = None

    def before(self, sibling: Node, kid: Node) -> None:
        kid.parent = self
        self.kids.insert(position(self.kids, sibling), kid)


def position(rows: list, one) -> int:
    """Where one is, looked for from the end, as that is where pages are built; -1 if nowhere."""
    return next((i for i in range(len(rows) - 1, -1, -1) if rows[i] is one), -1)


class Builder:
    def __init__(self) -> None:
        self.top = Node("", [])
        self.open: list[Node] = []
        self.counts: dict[str, int] = {}
        self.formats: list[Node | None] = []  # open formatting elements, None where a cell or the like begins

    @property
    def now(self) -> Node:
        return self.open[-1] if self.open else self.top

    # --- the stack of open elements

    def push(self, node: Node) -> None:
        if len(self.open) == DEEPEST:
            self.pop()
        self.insert(node)
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.open.pop()
        self.counts[node.tag] -= 1
        if node.tag in MARKERS:
            while self.formats and self.formats.pop() is not None:
                pass
        return node

    def drop(self, at: int) -> None:
        self.counts[self.open.pop(at).tag] -= 1

    def put(self, at: int, node: Node) -> None:
        self.open.insert(at, node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def within(self, tags, bounds: frozenset[str]) -> int:
        """The innermost open element of the tags, if no bound is further in; else -1."""
        if any(self.counts.get(t) for t in tags):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in tags:
                    return i
                if self.open[i].tag in bounds:
                    break
        return -1

    def close(self, tags, bounds: frozenset[str]) -> bool:
        at = self.within(tags, bounds)
        while at >= 0 and len(self.open) > at:
            self.pop()
        return at >= 0

    def back_to(self, tags: frozenset[str]) -> None:
        while self.open and self.now.tag not in tags and self.now.tag not in TABLE_SCOPE:
            self.pop()

    # --- where things go

    def insert(self, node: Node, under: Node | None = None) -> None:
        """Into the current element; if that is of a table's skeleton, which holds no such thing, before the table."""
        under = under or self.now
        if under.tag in IN_TABLE and node.tag not in IN_TABLE and node.tag not in CELLS and node.tag not in COLUMNS and node.tag not in STAYS_IN_TABLE and node.tag not in ("col", "form"):
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table"), -1)
            if at >= 0 and not (node.tag is None and not node.text.strip(" \t\r\n\f")):
                table = self.open[at]
                if table.parent is not None:
                    table.parent.before(table, node)
                else:
                    (self.open[at - 1] if at else self.top).append(node)
                return
        under.append(node)

    # --- formatting elements

    def reopen(self) -> None:
        """Opens again the formatting elements that something else has closed."""
        if not self.formats or self.formats[-1] is None:
            return
        live = set(map(id, self.open))
        at = len(self.formats)
        while at and self.formats[at - 1] is not None and id(self.formats[at - 1]) not in live:
            at -= 1
        for i in range(at, len(self.formats)):
            self.formats[i] = node = self.formats[i].again()
            self.push(node)

    def since_marker(self) -> int:
        return next((i + 1 for i in range(len(self.formats) - 1, -1, -1) if self.formats[i] is None), 0)

    def formatting(self, node: Node) -> None:
        """Of equal ones three at most are kept, and FORMATTING of all."""
        first = self.since_marker()
        same = [i for i in range(first, len(self.formats)) if self.formats[i].tag == node.tag and self.formats[i].attrs == node.attrs]
        if len(same) > 2:
            self.formats.pop(same[0])
        elif len(self.formats) - first >= FORMATTING:
            self.formats.pop(first)
        self.push(node)
        self.formats.append(node)

    def forget(self, node: Node) -> None:
        at = position(self.formats, node)
        if at >= 0:
            self.formats.pop(at)

    def end_other(self, tag: str) -> None:
        """The end of an element that isn't special: special ones hold it back."""
        if self.counts.get(tag):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    return
                if self.open[i].tag in SPECIAL:
                    return

    def end_format(self, tag: str) -> None:
        """The end of a formatting element: a block that is open inside it moves out, with what is left of the formatting inside the block."""
        if self.now.tag == tag and position(self.formats, self.now) < 0:
            self.pop()
            return
        for _ in range(8):
            first = self.since_marker()
            mine = next((self.formats[i] for i in range(len(self.formats) - 1, first - 1, -1) if self.formats[i].tag == tag), None)
            if mine is None:
                self.end_other(tag)
                return
            at = position(self.open, mine)
            if at < 0:
                self.forget(mine)
                return
            if any(n.tag in SCOPE for n in self.open[at + 1 :]):
                return
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), -1)
            if block < 0:
                while self.pop() is not mine:
                    pass
                self.forget(mine)
                return
            self.adopt(at, block)

    def adopt(self, at: int, block_at: int) -> None:
        mine, block = self.open[at], self.open[block_at]
        above = self.open[at - 1] if at else self.top
        mark = position(self.formats, mine)
        last, steps, i = block, 0, block_at
        while True:
            i -= 1
            node = self.open[i]
            if node is mine:
                break
            steps += 1
            listed = position(self.formats, node)
            if steps > 3 and listed >= 0:
                self.formats.pop(listed)
                mark -= listed < mark
                listed = -1
            if listed < 0:
                self.drop(i)
                continue
            self.open[i] = self.formats[listed] = copy = node.again()
            if last is block:
                mark = listed + 1
            last.remove()
            copy.append(last)
            last = copy
        last.remove()
        self.insert(last, above)
        copy = mine.again()
        for kid in block.kids:
            kid.parent = copy
        copy.kids, block.kids = block.kids, []
        block.append(copy)
        old = position(self.formats, mine)
        self.formats.pop(old)
        self.formats.insert(mark - (old < mark), copy)
        self.drop(at)
        self.put(position(self.open, block) + 1, copy)

    # --- tags and texts

    def text(self, text: str) -> None:
        if text and (self.open or text.strip()):
            if text.strip(" \t\r\n\f"):
                self.reopen()
            self.insert(Node(None, [], text))

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        node = Node(tag, attrs)
        if tag in ENDS_P:
            self.close(("p",), BUTTON_SCOPE)
            if tag in HEADINGS and self.now.tag in HEADINGS:
                self.pop()
        if tag in ENDS:
            self.close(*ENDS[tag])
            if tag in ("li", "dt", "dd"):
                self.close(("p",), BUTTON_SCOPE)
        if tag in CELLS or tag == "tr" or tag in SECTIONS or tag in COLUMNS or tag == "col":
            if self.within(("table",), frozenset(("html", "template"))) < 0:
                return  # of no table
            self.back_to(SECTIONS | {"tr"} if tag in CELLS else SECTIONS if tag == "tr" else frozenset(("colgroup",)) if tag == "col" else frozenset())
        elif tag == "table" and self.now.tag in IN_TABLE:
            self.close(("table",), TABLE_SCOPE)
        if tag == "a":
            first = self.since_marker()
            if old := next((n for n in self.formats[first:] if n.tag == "a"), None):
                self.end_format("a")
                self.forget(old)
                if (at := position(self.open, old)) >= 0:
                    self.drop(at)
        if tag == "nobr" and self.within(("nobr",), SCOPE) >= 0:
            self.end_format("nobr")
        if tag in FORMATS:
            self.reopen()
            self.formatting(node)
            return
        if tag not in SPECIAL or tag in ("br", "button", "img", "input", "embed", "area", "wbr", "applet", "marquee", "object", "select", "option"):
            self.reopen()
        if tag in VOID:
            self.insert(node)
            return
        self.push(node)
        if tag in MARKERS:
            self.formats.append(None)

    def end(self, tag: str) -> None:
        if tag in FORMATS:
            self.end_format(tag)
        elif tag == "p":
            if not self.close(("p",), BUTTON_SCOPE):
                self.insert(Node("p", []))
        elif tag == "br":
            self.start("br", [])
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag == "li":
            self.close(("li",), LIST_SCOPE)
        elif tag in ("table", "tr") or tag in SECTIONS or tag in CELLS or tag in COLUMNS:
            self.close((tag,), TABLE_SCOPE)
        elif tag in SPECIAL:
            self.close((tag,), SELECT_SCOPE if tag == "select" else frozenset() if tag in ("html", "body", "template") else SCOPE - {tag})
        else:
            self.end_other(tag)


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def closed_references(text: str) -> str:
    """Decodes the character references that end with a semicolon; others stay as they are written."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text)


def built(page: str, decode: Callable[[str], str] = html.unescape) -> Node:
    tree = Builder()
    for kind, name, more in tokens(page, PLAIN):
        if kind == TEXT:
            tree.text(decode(name))
        elif kind == RAW:
            if name:
                tree.now.append(Node(None, [], decode(name) if more in ("title", "textarea") else name))
            if tree.open and tree.now.tag == more:
                tree.pop()
        elif kind == CLOSE:
            tree.end(name)
        else:
            tree.start(name, list(attributes(more).items()))
    return tree.top


def nested(page: str) -> Node:
    """The tree of XML."""
    tree = Builder()
    for kind, name, more in tokens(page, frozenset(), True):
        if kind == CLOSE:
            tree.close((name,), frozenset())
        elif kind in (TEXT, RAW):
            text = html.unescape(name) if kind == TEXT else name
            if text and (tree.open or text.strip()):
                tree.now.append(Node(None, [], text))
        else:
            node = Node(name, list(attributes(more, False).items()))
            if len(tree.open) == DEEPEST:
                tree.open.pop()
            tree.now.append(node)
            if not more.endswith("/"):
                tree.open.append(node)
                tree.counts[name] = tree.counts.get(name, 0) + 1
    return tree.top


def listed(top: Node) -> list[dict]:
    """The nodes below top in document order, each with its place, its last descendant, its parent and its ancestors."""
    out: list[dict] = []
    left = [(kid, None, []) for kid in reversed(top.kids)]
    while left:
        node, parent, path = left.pop()
        if node is None:  # all below has been listed
            out[parent]["last"] = len(out) - 1
            continue
        me = len(out)
        out.append({"pre": me, "last": me, "level": len(path), "parent": parent, "path": path, "tag": node.tag, "attrs": node.attrs, "text": node.text})
        if node.kids:
            below = [*path, me]
            left.append((None, me, path))
            left.extend((kid, me, below) for kid in reversed(node.kids))
    return out


def parse(page: str, xml: bool = False, closed: bool = False) -> list[dict]:
    """Nodes of a page; text nodes have no tag. White space at the very start and end of the page makes no node.

    closed: of the references in an HTML page's text only those with a semicolon are decoded, as titles and the SQL have it.
    """
    return listed(nested(page) if xml else built(page, closed_references if closed else html.unescape))
