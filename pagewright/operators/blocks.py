"""The block walker: an element's content as headings, paragraphs and bullets, in one pass over its nodes.

It runs where the page is parsed, so a page is read once and nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import utf16_length
from pagewright.operators.nodes import normal

#: Elements whose content is left out, that are headings, that make text strong, that are lists.
IGNORED = ("script", "style", "noscript", "svg")
HEADINGS = ("h1", "h2", "h3", "h4")
STRONG = ("strong", "b")
LISTS = ("ul", "ol")
BLOCK = "struct<kind:string,text:string,depth:int>"


def walk(nodes: list[dict], root: int) -> list[dict]:
    """Blocks (kind, text, depth) below a node, depth only for bullets; none if it has no text. The root's own tag doesn't count.

    A list's children are items whatever their tags, and a list directly in a list isn't one; loose text in a list is left out.
    """
    out: list[dict] = []
    held: list[tuple[str, bool]] = []

    def flush(kind: str, depth: int) -> None:
        text = normal("".join(t for t, _ in held))
        if text:
            if kind != "bullet":
                kind = "heading" if text.endswith(":") or all(strong or not normal(t) for t, strong in held) else "paragraph"
            out.append({"kind": kind, "text": text, "depth": depth if kind == "bullet" else None})
        held.clear()

    # of each element that is open: where it ends, whether a block ends with it, and what holds inside
    inside = [(nodes[root]["last"], True, False, "paragraph", 0, False)]
    i = root + 1
    while inside:
        last, ends, in_list, kind, depth, strong = inside[-1]
        if i > last:
            inside.pop()
            if ends:
                flush(kind, depth)
            continue
        node = nodes[i]
        i += 1
        if node["tag"] is None:
            if not in_list:
                held.append((node["text"], strong))
            continue
        tag = node["tag"].lower()
        if in_list:
            inside.append((node["last"], True, False, "bullet" if tag == "li" else "paragraph", depth, False))
        elif tag in IGNORED:
            i = node["last"] + 1
        elif tag == "br" or tag in HEADINGS:
            flush(kind, depth)
            if tag != "br":
                text = normal("".join(n["text"] for n in nodes[i : node["last"] + 1] if n["tag"] is None))
                if text:
                    out.append({"kind": "heading", "text": text, "depth": None})
            i = node["last"] + 1
        elif tag in LISTS:
            flush(kind, depth)
            inside.append((node["last"], False, True, kind, depth + 1, False))
        elif tag in ("li", "p"):
            flush(kind, depth)
            inside.append((node["last"], True, False, "bullet" if tag == "li" else "paragraph", depth, strong))
        else:
            inside.append((node["last"], False, False, kind, depth, strong or tag in STRONG))
    return out


def char_count(blocks: Column) -> Column:
    """UTF-16 units of all blocks' text."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + utf16_length(b["text"]))
