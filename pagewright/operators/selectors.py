"""Selectors: read once into compounds, which are tested on an element of a page being read, or as columns on trees in a table.

A selector is alternatives, told apart by `,`, of compounds, told apart by white space: each has to hold for an element around
that of the next. A compound is a tag or `*`, classes, an id, and attributes that exist or compare by =, ^=, $= or *=. In an
attribute's value `{name}` stands for a parameter. Tags and classes are compared as ASCII white space parts them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.operators import nodes as tree

_PART = re.compile(r"""\s*(?:(\*|[a-zA-Z][\w-]*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([\^$*]?=)"([^"]*)")?\])""")
_CLASSES = re.compile(r"[^ \t\n\f\r]+")


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    classes: tuple[str, ...] = ()
    id: str | None = None
    attrs: tuple[tuple[str, str | None, str | None], ...] = ()

    def keys(self) -> Iterator[tuple[str, str]]:
        """What an element of the compound is indexed under, among others."""
        if self.tag:
            yield "tag", self.tag
        for name in self.classes:
            yield "class", name
        if self.id:
            yield "id", self.id
        for name, _, _ in self.attrs:
            yield "attr", name


def keys_of(tag: str, attrs: Mapping[str, str]) -> Iterator[tuple[str, str]]:
    """All that an element is indexed under."""
    yield "tag", tag.lower()
    for name in attrs:
        yield "attr", name
    for name in set(_CLASSES.findall(attrs.get("class", ""))):
        yield "class", name
    if attrs.get("id"):
        yield "id", attrs["id"]


@lru_cache(maxsize=256)
def compiled(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """The chains of compounds of a selector's alternatives."""
    return tuple(tuple(_compound(part) for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one)) for one in selector.split(","))


def _compound(part: str) -> Compound:
    tag, id_, classes, attrs = None, None, [], []
    at = 0
    while at < len(part):
        m = _PART.match(part, at)
        if m is None:
            raise ValueError(f"selector not understood: {part}")
        at = m.end()
        if m[1]:
            tag = m[1].lower() if m[1] != "*" else None
        elif m[2]:
            classes.append(m[2])
        elif m[3]:
            id_ = m[3]
        else:
            attrs.append(m.groups()[3:])
    return Compound(tag, tuple(classes), id_, tuple(attrs))


def passes(compound: Compound, tag: str, attrs: Mapping[str, str], params: Mapping[str, str]) -> bool:
    """Whether an element, of the tag and attributes, is of the compound."""
    if (compound.tag and tag.lower() != compound.tag) or (compound.id and attrs.get("id") != compound.id):
        return False
    if compound.classes and not set(compound.classes) <= set(_CLASSES.findall(attrs.get("class", ""))):
        return False
    return all(name in attrs and (op is None or _compares(attrs[name], op, value.format(**params) if "{" in value else value)) for name, op, value in compound.attrs)


def _compares(own: str, op: str, value: str) -> bool:
    return own == value if op == "=" else bool(value) and {"^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own}[op]


# --- the same on columns


def column_test(compound: Compound, params: Mapping[str, Column]) -> Callable[[Column], Column]:
    """The test of a node, as tree.select takes it."""
    tests = [tree.tag_is(compound.tag)] if compound.tag else []
    tests += [tree.class_is(name) for name in compound.classes]
    tests += [tree.attr_is("id", compound.id)] if compound.id else []
    compare = {"=": tree.attr_is, "^=": tree.attr_starts, "$=": tree.attr_ends, "*=": tree.attr_contains}
    for name, op, value in compound.attrs:
        if op in ("^=", "$=", "*=") and not value:
            return lambda n: F.lit(False)
        tests.append(tree.has(name) if op is None else compare[op](name, _filled(value, params) if op == "=" else value))
    return tree.both(*tests)


def _filled(value: str, params: Mapping[str, Column]):
    if "{" not in value:
        return value
    parts = [params[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.findall(r"\{\w+\}|[^{]+", value)]
    return F.concat(*parts)


def test_of(selector: str, nodes: Column, params: Mapping[str, Column] | None = None) -> Callable[[Column], Column]:
    """The test of a node of `nodes` by a selector; parameters stand in whole values only."""

    def chain(compounds: tuple[Compound, ...]) -> Callable[[Column], Column]:
        test = column_test(compounds[-1], params or {})
        if len(compounds) == 1:
            return test
        # the nearest fitting ancestor first: any further chain that fits above another one fits above it too
        outer = [column_test(c, params or {}) for c in compounds[:-1]]

        def held(n: Column) -> Column:
            state = F.lit(len(outer))
            for_each = F.reverse(n["path"])

            def step(left: Column, p: Column) -> Column:
                ancestor = F.get(nodes, p)
                hit = F.lit(False)
                for k, t in enumerate(outer, 1):
                    hit = F.when(left == k, t(ancestor)).otherwise(hit)
                return F.when(F.coalesce(hit, F.lit(False)), left - 1).otherwise(left)

            return test(n) & (F.aggregate(for_each, state, step) == 0)

        return held

    chains = [chain(c) for c in compiled(selector)]

    def any_of(n: Column) -> Column:
        out = chains[0](n)
        for c in chains[1:]:
            out = out | c(n)
        return out

    return any_of


def select_all(selector: str, nodes: Column, root: Column, params: Mapping[str, Column] | None = None) -> Column:
    """The elements below root that a selector finds, in document order."""
    return tree.select(nodes, root, test_of(selector, nodes, params))
