"""Text kernel: column functions that every other module builds on.

White space is the set a browser's scripts mean by it, spelled out because regex engines disagree; lengths are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space.
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Named character references that are decoded natively.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
#: The separator and the count prefix of page titles.
TITLE_SEPARATOR = " | "
TITLE_COUNT = rf"\A\([0-9]+\){WS}+"


def normalize_text(x: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.char_length(x) + F.size(F.regexp_extract_all(x, F.lit(r"[\x{10000}-\x{10ffff}]"), F.lit(0)))).cast("long")


def non_empty(x: Column) -> Column:
    """Normalised text, or null where nothing is left."""
    return F.nullif(normalize_text(x), F.lit(""))


def first_capture(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def decode_entities(x: Column) -> Column:
    """Decodes ENTITIES, the ampersand last."""
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def document_title(html: Column) -> Column:
    """The text of the first <title>, decoded, white space collapsed; empty if there is none."""
    return normalize_text(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)))


def title_parts(title: Column) -> Column:
    """(first, second): the title's first segment without its count, and the second if there are three or more."""
    parts = F.split(title, r" \| ")
    first = F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), TITLE_COUNT, "")
    return F.struct(first.alias("first"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).alias("second"))


def split_sentences(x: Column) -> Column:
    """Sentences: cut at white space after a full stop, question or exclamation mark."""
    return F.filter(F.split(x, rf"(?<=[.!?]){WS}+"), lambda s: s != "")
