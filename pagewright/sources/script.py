"""Script source as rows of nodes: names, whole strings, members, computed members and bindings.

Two passes over a file, both of linear time. `lex` reads characters: it tells regular expressions from divisions, follows
templates into their substitutions and markup into its expressions, and pairs brackets. `nodes` reads the tokens: it finds where
the expression before a member begins and which braces are patterns. What is looked for is decided later, on columns.

Types aren't told from expressions: a qualified name or an indexed type counts as a member. After type arguments in angle
brackets a member's text begins at the bracket that follows them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "line int, kind string, name string, text string"
IDENTIFIER, STRING, MEMBER, COMPUTED, BINDING = "identifier", "string", "member", "computed", "binding"

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NAME = re.compile(r"#?(?:[\w$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+")
_NUMBER = re.compile(r"0[xXbBoO][\w]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?\.?(?!\w)|\d[\w.]*")
_QUOTED = {q: re.compile(rf"{q}((?:\\.|[^{q}\\\n])*){q}?", re.S) for q in "'\""}
_SPAN = re.compile(r"((?:\\(?:.|\Z)|\$(?!\{)|[^`\\$])*)(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_SIGN = re.compile(r"\.\.\.|=>|\?\.(?!\d)|\+\+|--|.", re.S)
_TAG_NAME = re.compile(r"[\w$-]+")
_CHILD = re.compile(r"[<{]")
#: What begins an element rather than type parameters.
_ELEMENT = re.compile(r"<\s*(?:>|[A-Za-z_$](?![\w$]*\s*(?:,|extends\b)))")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}
#: Words after which an operand comes, and those whose brackets hold no arguments.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())
_CONTROL = frozenset("if for while switch with catch".split())
_DECLARE = frozenset(("const", "let", "var"))
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str  # name, string, number, regex, span, sign, markup
    value: str
    start: int
    end: int
    operand: bool = True  # whether an operand may come next
    pair: int = -1  # of a bracket or the end of a template or tag: where it began; of an opening bracket: where it ends


def cooked(raw: str) -> str:
    """What an escaped text stands for."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            at = int(code, 16)
            return chr(at) if at < 0xD800 or 0xDFFF < at < 0x110000 else "\ufffd"
        return _PLAIN_ESCAPES.get(m[4], m[4])

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


def lex(code: str, markup: bool) -> list[Token]:
    """The tokens of a file; markup: whether `<` may begin an element."""
    out: list[Token] = []
    open_: list[tuple[str, int]] = []  # ( [ { , block, template, tag, ending, children, hole
    at = 0

    def add(kind: str, value: str, end: int, operand: bool, pair: int = -1) -> None:
        nonlocal at
        out.append(Token(kind, value, at, end, operand, pair))
        at = end

    def span(head: int) -> None:
        """A template's text up to its end or the next substitution."""
        m = _SPAN.match(code, at + 1)
        whole = head < 0 and m[2] != "${"
        me = len(out)
        add("string" if whole else "span", cooked(m[1]), m.end(), m[2] == "${", head)
        if m[2] == "${":
            open_.append(("template", me if head < 0 else head))

    while at < len(code):
        mode = open_[-1][0] if open_ else ""
        if mode == "children":
            m = _CHILD.search(code, at)
            if m is None:
                break
            at = m.start()
            if code[at] == "{":
                open_.append(("hole", len(out)))
                add("markup", "{", at + 1, True)
            elif code.startswith("</", at):
                open_[-1] = ("ending", open_[-1][1])
                add("markup", "</", at + 2, True)
            else:
                open_.append(("tag", len(out)))
                add("markup", "<", at + 1, True)
            continue
        m = _SPACE.match(code, at)
        if m:
            at = m.end()
            continue
        c = code[at]
        if mode in ("tag", "ending"):
            begun = open_[-1][1]
            if c == ">" or code.startswith("/>", at):
                if mode == "tag" and c == ">":
                    open_[-1] = ("children", begun)
                    add("markup", ">", at + 1, True)
                else:
                    open_.pop()
                    add("markup", ">", at + (1 if c == ">" else 2), False, begun)
            elif c == "{":
                open_.append(("hole", len(out)))
                add("markup", "{", at + 1, True)
            elif c in "'\"":
                end = code.find(c, at + 1)
                end = len(code) if end < 0 else end + 1
                add("string", code[at + 1 : end - 1], end, False)
            elif m := _TAG_NAME.match(code, at):
                add("name", m[0], m.end(), False)
            else:
                add("sign" if c == "." else "markup", c, at + 1, True)
            continue
        operand = out[-1].operand if out else True
        if m := _NUMBER.match(code, at) if c.isdigit() or (c == "." and code[at + 1 : at + 2].isdigit()) else None:
            add("number", m[0], m.end(), False)
        elif m := _NAME.match(code, at):
            member = bool(out) and out[-1].value in (".", "?.") and out[-1].kind == "sign"
            add("name", cooked(m[0]), m.end(), m[0] in _BEFORE_OPERAND and not member)
        elif c in _QUOTED:
            m = _QUOTED[c].match(code, at)
            add("string", cooked(m[1]), m.end(), False)
        elif c == "`":
            span(-1)
        elif c == "/" and operand and (m := _REGEX.match(code, at)):
            add("regex", m[0], m.end(), False)
        elif c == "<" and markup and operand and _ELEMENT.match(code, at):
            open_.append(("tag", len(out)))
            add("markup", "<", at + 1, True)
        elif c in "([{":
            before = out[-1] if out else None
            block = c == "{" and (not operand or before is None or before.value in ("{", "}", ";", ")", "=>", "else", "do") or (before.value == ":" and mode == "block"))
            open_.append(("block" if block else c, len(out)))
            add("sign", c, at + 1, True)
        elif c in ")]}":
            if c == "}" and mode == "template":
                span(open_.pop()[1])
                continue
            if c == "}" and mode == "hole":
                add("markup", "}", at + 1, True, open_.pop()[1])
                continue
            pair = -1
            if mode == _PAIRS[c] or (c == "}" and mode == "block"):
                pair = open_.pop()[1]
                out[pair].pair = len(out)
            control = c == ")" and pair > 0 and out[pair - 1].kind == "name" and out[pair - 1].value in _CONTROL
            add("sign", c, at + 1, control or (c == "}" and mode == "block"), pair)
        else:
            sign = _SIGN.match(code, at)[0]
            add("sign", sign, at + len(sign), operand if sign in ("++", "--") else not (sign == "!" and not operand and code[at + 1 : at + 2] in tuple(".[(!)")))
    return out


def beginnings(tokens: list[Token]) -> list[int]:
    """For each token that may end an expression: the token where the chain of members, calls and indexes that it ends begins."""
    out = list(range(len(tokens)))
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        if before is None:
            continue
        if t.kind == "name" and before.kind == "sign" and before.value in (".", "?.") and i > 1 and not tokens[i - 2].operand:
            out[i] = out[i - 2]
        elif t.kind == "sign" and t.value in (")", "]") and t.pair >= 0:
            head = t.pair - 1
            if head >= 0 and tokens[head].value == "?." and tokens[head].kind == "sign":
                head -= 1
            callee = head >= 0 and not tokens[head].operand and not (t.value == ")" and tokens[head].kind == "name" and tokens[head].value in _CONTROL)
            out[i] = out[head] if callee else t.pair
            if callee and t.value == ")" and out[i] and tokens[out[i] - 1].kind == "name" and tokens[out[i] - 1].value == "new":
                out[i] -= 1
        elif t.kind == "span" or (t.kind == "markup" and t.pair >= 0):
            out[i] = out[t.pair] if t.pair >= 0 else i
        elif t.value == "!" and t.kind == "sign" and not t.operand:
            out[i] = out[i - 1]
        if t.kind in ("string", "span") and t.pair < 0 and not before.operand and before.kind in ("name", "sign"):
            out[i] = out[i - 1]  # a tagged template
    return out


def parameters(tokens: list[Token], at: int) -> bool:
    """Whether the bracket that opens at `at` holds parameters."""
    end = tokens[at].pair
    if end < 0:
        return False
    value = lambda i: tokens[i].value if 0 <= i < len(tokens) and tokens[i].kind in ("name", "sign") else ""
    if value(end + 1) == "=>" or value(at - 1) in ("function", "catch") or value(at - 2) == "function" or (value(at - 2) == "*" and value(at - 3) == "function"):
        return True
    before = tokens[at - 1] if at else None
    named = before is not None and (before.kind in ("name", "string") or before.value in ("]", ">")) and before.value not in _CONTROL
    if named and value(end + 1) == "{":
        return True
    if value(end + 1) != ":" or value(at - 1) == "?":
        return False
    i = end + 2  # a type, up to an arrow or a body
    while i < len(tokens) and value(i) not in (";", ",", ")", "]", "}", "=", "=>"):
        if named and value(i) == "{" and i > end + 2 and value(i - 1) not in ("|", "&", ":"):
            return True
        i = max(i, tokens[i].pair) + 1
    return value(i) == "=>"


def patterns(tokens: list[Token]) -> list[int]:
    """Where the patterns of declarations and parameters open."""
    out, declares, held = [], [False], [""]
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        if t.kind == "sign" and t.value in ("{", "[") and before is not None:
            first = held[-1] == "parameters" and before.value in ("(", ",", "...")
            more = declares[-1] and before.kind == "sign" and before.value == ","
            if first or more or (before.kind == "name" and before.value in _DECLARE):
                out.append(i)
        if t.kind == "name" and t.value in _DECLARE:
            declares[-1] = True
        elif t.kind == "sign" and t.value == ";":
            declares[-1] = False
        if (t.kind == "sign" and t.value in ("(", "[", "{")) or (t.kind == "markup" and t.value == "{"):
            held.append("parameters" if t.value == "(" and parameters(tokens, i) else t.value)
            declares.append(False)
        elif (t.kind in ("sign", "markup") and t.value in (")", "]", "}")) and t.pair >= 0 and len(held) > 1:
            held.pop()
            declares.pop()
    return out


def elements(tokens: list[Token], open_: int) -> Iterator[tuple[int, int]]:
    """(first, beyond last) of the tokens of each element of a bracket."""
    first = i = open_ + 1
    while i < tokens[open_].pair:
        if tokens[i].kind == "sign" and tokens[i].value == ",":
            if i > first:
                yield first, i
            first = i + 1
        i = max(i, tokens[i].pair) + 1
    if first < tokens[open_].pair:
        yield first, tokens[open_].pair


def bindings(tokens: list[Token], code: str) -> Iterator[tuple[str, int, int]]:
    """(name of the property, else of what is bound; first and last token) of each element of the patterns, inner ones too."""
    left = patterns(tokens)[::-1]
    while left:
        open_ = left.pop()
        for first, beyond in elements(tokens, open_):
            key = first + (tokens[first].value == "...")
            if key >= beyond:
                continue
            last = max(key, tokens[key].pair)
            target = key
            if tokens[open_].value == "{" and last + 2 < beyond and tokens[last + 1].value == ":":
                target = last + 2
            yield code[tokens[key].start : tokens[last].end], first, beyond - 1
            if target < beyond and tokens[target].value in ("{", "[") and tokens[target].kind == "sign" and (target != key or tokens[open_].value == "["):
                left.append(target)


def nodes(code: str, markup: bool = True, names: Collection[str] | None = None) -> list[tuple[int, str, str, str]]:
    """(line, kind, name, text) of the nodes of a file, in the order of where they begin; line and text are of the whole node. With names only those of them."""
    tokens = lex(code, markup)
    begins = beginnings(tokens)
    found: list[tuple[int, int, str, str]] = []
    for i, t in enumerate(tokens):
        if t.kind == "name" and not t.value.startswith("#"):
            found.append((t.start, t.end, IDENTIFIER, t.value))
        elif t.kind == "string":
            found.append((t.start, t.end, STRING, t.value))
        if t.kind == "name" and begins[i] != i:
            found.append((tokens[begins[i]].start, t.end, MEMBER, t.value))
        if t.value == "]" and t.kind == "sign" and t.pair == i - 2 and tokens[i - 1].kind == "string" and begins[i] != t.pair:
            found.append((tokens[begins[i]].start, t.end, COMPUTED, tokens[i - 1].value))
    found += [(tokens[a].start, tokens[b].end, BINDING, name) for name, a, b in bindings(tokens, code)]
    if names is not None:  # texts are cut out of those alone: the members of a long chain are each as long as it is
        found = [f for f in found if f[3] in names]
    starts = [m.end() for m in re.finditer("\n", code)]
    return [(bisect_right(starts, a) + 1, kind, name, code[a:b]) for a, b, kind, name in sorted(found)]


#: Rows of files that are read at once.
PIECE_ROWS = 50


def code_nodes(files: DataFrame, names: Collection[str] | None = None) -> DataFrame:
    """(path, nth, line, kind, name, text) of the nodes in files (path, code), with names only of those; without code there are none.

    kind is identifier, string (a whole literal, quotes in its text), member (`a.name`), computed (`a['name']`) or binding (an
    element of a pattern in a declaration or a parameter). Names in comments, markup's text and regular expressions are none.
    """
    schema = f"path string, nth int, {NODE}"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                paths, codes = (c.to_pylist() for c in batch.slice(at, PIECE_ROWS).columns)
                rows = [(p, n, *x) for p, c in zip(paths, codes) for n, x in enumerate(nodes(c or "", not (p or "").endswith((".ts", ".mts", ".cts")), names))]
                columns = zip(*rows) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "nth", "line", "kind", "name", "text"])

    return files.select(F.col("path").cast("string"), F.col("code").cast("string")).mapInArrow(read, schema)
