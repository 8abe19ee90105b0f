"""Markup as a stream of text, tags and raw text, read in one pass whose time grows with the page's length only.

Tags are read as HTML reads them: a value ends with its own kind of quote, an unquoted one at white space or `>` whatever
quotes it holds; a tag, comment or quote that the page never ends takes the rest of the page with it. `<` that begins no tag is
text. No pattern can go back over what it has passed, so hostile pages cost no more than others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TEXT, OPEN, CLOSE, RAW = range(4)

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_NEXT = re.compile(r"<(?=[!?/a-zA-Z_])")
_TAG = re.compile(rf"</?+([a-zA-Z_][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}|(?!\s*+=)))*+)>")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_ENDS = {}


def attributes(source: str, lower: bool = True) -> dict[str, str]:
    """The attributes of a tag, decoded; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(source):
        out.setdefault(name.lower() if lower else name, html.unescape("".join(values)))
    return out


def _end_of(name: str) -> re.Pattern:
    if name not in _ENDS:
        _ENDS[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)
    return _ENDS[name]


def tokens(page: str, raw: frozenset[str] = frozenset(), xml: bool = False) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ""), (OPEN, name, attributes' source), (CLOSE, name, "") and, for elements named in raw, (RAW, text, name) for all up to their end tag.

    Names are lower case unless xml, where CDATA is a RAW of no name; elsewhere it's a comment.
    """
    at = 0
    while True:
        m = _NEXT.search(page, at)
        if m is None:
            if at < len(page):
                yield TEXT, page[at:], ""
            return
        start = m.start()
        if start > at:
            yield TEXT, page[at:start], ""
        after = page[start + 1]
        tag = None
        if page.startswith("!--", start + 1):
            end = start + 4 if page.startswith(">", start + 4) else page.find("-->", start + 4)
            at = len(page) if end < 0 else end + (1 if end == start + 4 and page[end] == ">" else 3)
        elif xml and page.startswith("![CDATA[", start + 1):
            end = page.find("]]>", start + 9)
            yield RAW, page[start + 9 :] if end < 0 else page[start + 9 : end], ""
            at = len(page) if end < 0 else end + 3
        elif after in "!?" or (after == "/" and not page[start + 2 : start + 3].isalpha() and page[start + 2 : start + 3] != "_"):
            end = page.find(">", start + 1)
            at = len(page) if end < 0 else end + 1
        else:
            tag = _TAG.match(page, start)
            if tag is None:  # a tag without an end
                return
            at = tag.end()
        if tag is None:
            continue
        name = tag[1] if xml else tag[1].lower()
        if after == "/":
            yield CLOSE, name, ""
            continue
        yield OPEN, name, tag[2]
        if name in raw:
            end_tag = _end_of(name).search(page, at)
            yield RAW, page[at:] if end_tag is None else page[at : end_tag.start()], name
            if end_tag is None:
                return
            tag = _TAG.match(page, end_tag.start())
            if tag is None:
                return
            at = tag.end()
