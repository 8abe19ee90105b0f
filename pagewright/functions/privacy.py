"""Removal of personal data from lines of text, before anything leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import normalize_text

#: What is swept, in this order; and words whose lines are withheld whole.
SWEPT = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("url", r"(?:https?://|www\.)[^ \t\r\n]+"),
    ("handle", r"@[A-Za-z0-9_]{2,}"),
    ("phone", r"\+?[0-9][0-9 ().-]{7,}[0-9]"),
    ("street", r"[0-9]{1,5} [A-Z][a-z]+ (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b\.?"),
)
#: Without any of these no pattern can match: one plain search spares most lines the patterns.
NEEDED = r"[@0-9]|://|www\."
PROTECTED = (
    "date of birth", "age", "gender", "marital status", "children", "nationality", "citizenship", "visa status", "religion", "ethnicity", "health", "disability", "photo",
)


def sweep(x: Column) -> Column:
    """A line without e-mails, URLs, handles, phone numbers and street addresses; null where nothing is left."""
    swept = x
    for _, pattern in SWEPT:
        swept = F.regexp_replace(swept, pattern, "")
    return F.nullif(normalize_text(F.when(x.rlike(NEEDED), swept).otherwise(x)), F.lit(""))


def leaks(x: Column) -> Column:
    """Whether any swept pattern still occurs."""
    found = F.lit(False)
    for _, pattern in SWEPT:
        found = found | x.rlike(pattern)
    return x.rlike(NEEDED) & found


def protected(x: Column) -> Column:
    """Whether a line names a protected attribute, and is withheld."""
    return F.lower(x).rlike(r"(?<![a-z])(?:" + "|".join(PROTECTED) + r")(?![a-z])")


def remove_strings(x: Column, strings: Column) -> Column:
    """x without any of an array of confirmed strings, longest first; empty and null ones do nothing."""
    known = F.filter(strings, lambda s: F.coalesce(s != "", F.lit(False)))
    ordered = F.array_sort(F.transform(known, lambda s: F.struct((-F.char_length(s)).alias("n"), s.alias("s"))))
    return F.aggregate(ordered, x, lambda t, s: F.replace(t, s["s"], F.lit("")))
