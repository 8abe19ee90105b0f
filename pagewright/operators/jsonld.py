"""Job postings in a page's JSON-LD: parsed as VARIANT, matched to the page, read field by field."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import non_empty, normalize_text
from pagewright.operators.nodes import attr_is, both, root_of, select, string_value, tag_is

#: The script that holds it, the type that counts, the parts of an address.
SCRIPT = "application/ld+json"
TYPE = "JobPosting"
ADDRESS = ("addressLocality", "addressRegion", "addressCountry")


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null for anything but a string."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))


def items(v: Column) -> Column:
    """The elements of an array, or the value itself as one; none for null or a missing value."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), many).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<variant>"))


def scripts(nodes: Column) -> Column:
    """The page's JSON-LD values in document order; what isn't JSON is left out."""
    found = F.transform(select(nodes, root_of(nodes), both(tag_is("script"), attr_is("type", SCRIPT))), lambda n: F.try_parse_json(string_value(nodes, n)))
    return F.filter(found, lambda v: v.isNotNull())


def _opened(text: str) -> list[str]:
    """The objects of TYPE in a JSON text, as JSON without their graphs; in time that grows with the text, however deep it is nested."""
    finite = lambda x: float(x) if math.isfinite(float(x)) else None
    left, out = [(json.loads(text, parse_float=finite, parse_constant=lambda _: None), False)], []
    while left:
        v, done = left.pop()
        if isinstance(v, list):
            left.extend((x, False) for x in reversed(v))
        elif isinstance(v, dict):
            if not done and "@graph" in v:
                left += [(v, True), (v["@graph"], False)]
                continue
            kinds = v.get("@type")
            if TYPE in (kinds if isinstance(kinds, list) else [kinds]):
                out.append(json.dumps({k: x for k, x in v.items() if k != "@graph"}))
    return out


def _each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda own: None if own is None else [p for t in own if t is not None for p in _opened(t)])


def postings(values: Column) -> Column:
    """Objects of TYPE in a list of values, however deep in arrays and graphs: of each value its @graph's first, then itself.

    They come without their own @graph, which has been opened.
    """
    found = F.pandas_udf(_each, "array<string>")(F.transform(values, lambda v: F.to_json(v)))
    return F.transform(found, lambda t: F.try_parse_json(t))


def matches(v: Column, job_id: Column, title: Column) -> Column:
    """Whether a posting is this job's: an identifier or the URL contains the id, or the title is the page's."""

    def named(i: Column) -> Column:
        return F.coalesce(F.contains(F.coalesce(text_at(i, "$"), text_at(i, "$.value")), job_id), F.lit(False))

    by_id = F.exists(items(F.try_variant_get(v, "$.identifier", "variant")), named)
    by_url = F.coalesce(F.contains(text_at(v, "$.url"), job_id), F.lit(False))
    return by_id | by_url | F.coalesce(non_empty(text_at(v, "$.title")) == normalize_text(title), F.lit(False))


def location(v: Column) -> Column:
    """The first usable location: a text as it is, or the parts of an address."""

    def one(place: Column) -> Column:
        parts = F.array(*(non_empty(text_at(place, f"$.address.{p}")) for p in ADDRESS))
        return F.coalesce(non_empty(text_at(place, "$")), F.nullif(F.array_join(parts, ", "), F.lit("")))

    found = F.transform(items(F.try_variant_get(v, "$.jobLocation", "variant")), one)
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def job(values: Column, job_id: Column, title: Column) -> Column:
    """(title, company, location) of the first posting that matches, or null."""

    def fields(v: Column) -> Column:
        name = non_empty(text_at(v, "$.hiringOrganization.name"))
        return F.struct(non_empty(text_at(v, "$.title")).alias("title"), name.alias("company"), location(v).alias("location"))

    first = F.slice(F.filter(postings(values), lambda p: matches(p, job_id, title)), 1, 1)
    return F.get(F.transform(first, fields), F.lit(0))
