"""Spans of private text in lines: what patterns find, with an owner's corrections laid over it, also on lines that were read anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,stop:int>>"
#: What a correction says: where the body begins, that a span is private, that a span isn't, and what section a line is in.
HEADER, PRIVATE, PUBLIC, SECTION = "header", "private", "public", "section"


def matched(x: Column, pattern: str) -> Column:
    """The spans (start, stop) of a pattern's matches, from 0, stop not included: lengths of what lies between them and of them, summed up."""
    between, inside = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    lengths = F.zip_with(F.transform(between, F.char_length), F.transform(inside, F.char_length), lambda b, m: F.struct(b.alias("before"), m.alias("own")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["before"]
        span = F.struct(start.alias("start"), (start + x["own"]).alias("stop"))
        return F.when(x["own"].isNull(), s).otherwise(F.struct(span["stop"].alias("at"), F.concat(s["out"], F.array(span)).alias("out")))

    return F.coalesce(F.aggregate(lengths, state, step)["out"], F.array().cast(SPANS))


def detected(x: Column, patterns: Sequence[str]) -> Column:
    return F.concat(*(matched(x, p) for p in patterns))


def covers(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= at) & (at < s["stop"]))


def kept_text(x: Column, found: Column, private: Column, public: Column) -> Column:
    """x without what is found or private; what is public stays, unless it is private too."""
    chars = F.sequence(F.lit(0), F.greatest(F.char_length(x) - 1, F.lit(0)))
    gone = lambda i: covers(private, i) | (covers(found, i) & ~covers(public, i))
    left = F.array_join(F.transform(F.filter(chars, lambda i: ~gone(i)), lambda i: F.substring(x, i + 1, F.lit(1))), "")
    return F.when((F.size(found) == 0) & (F.size(private) == 0), x).otherwise(left)


def anchored(lines: DataFrame, key: str) -> DataFrame:
    """lines (key, line_no, text) with `anchor`: which of the key's lines of that very text it is, so that it is found again when lines have moved."""
    return lines.withColumn("anchor", F.row_number().over(Window.partitionBy(key, F.xxhash64("text"), "text").orderBy("line_no")))


def noted(corrections: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """corrections (key, line_no, what, start, stop, section) of the lines as they were, as they are stored: with the line's text and anchor in place of its number."""
    return corrections.join(anchored(lines, key).select(key, "line_no", "text", "anchor"), [key, "line_no"]).drop("line_no")


def reapplied(lines: DataFrame, notes: DataFrame, key: str, patterns: Sequence[str]) -> DataFrame:
    """(key, line_no, section, text, header, corrected) of lines (key, line_no, section, text) that were read anew, under the notes.

    A note goes to the line of its text and anchor, wherever that now is; one whose line is gone has no effect. Lines above
    the one that a header note names (the last, if several) are the header. Private spans go, and what patterns find, but for
    public spans; private ones win. Of several sections noted for a line the first by name holds.
    """
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    of = lambda what: F.collect_list(F.when(F.col("what") == what, span))
    own = notes.groupBy(key, "text", "anchor").agg(
        of(PRIVATE).alias("_private"),
        of(PUBLIC).alias("_public"),
        F.min(F.when(F.col("what") == SECTION, F.col("section"))).alias("_section"),
        F.bool_or(F.col("what") == HEADER).alias("_begins"),
    )
    rows = anchored(lines, key).join(own, [key, "text", "anchor"], "left")
    none = F.array().cast(SPANS)
    body = F.max(F.when(F.col("_begins"), F.col("line_no"))).over(Window.partitionBy(key))
    text = kept_text(F.col("text"), detected(F.col("text"), patterns), F.coalesce("_private", none), F.coalesce("_public", none))
    return rows.select(
        key,
        "line_no",
        F.coalesce("_section", "section").alias("section"),
        text.alias("text"),
        F.coalesce(F.col("line_no") < body, F.lit(False)).alias("header"),
        F.col("_private").isNotNull().alias("corrected"),
    )
