"""Ordered fallbacks: the first step with a value wins, and every step tried is on record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = "struct<value:string,selector:string,confidence:string>"
HIT = "array<struct<field:string,selector:string,matched:int>>"


def field(value: Column, selector: str | Column, confidence: str) -> Column:
    """A field read by a step; null without a value."""
    label = F.lit(selector) if isinstance(selector, str) else selector
    return F.when(value.isNotNull(), F.struct(value.alias("value"), label.alias("selector"), F.lit(confidence).alias("confidence"))).cast(FIELD)


def pick(steps: Sequence[Column]) -> Column:
    """The first step's field that isn't null."""
    return F.coalesce(*steps, F.lit(None).cast(FIELD))


def hit(name: str, selector: str | Column, matched: Column) -> Column:
    label = F.lit(selector) if isinstance(selector, str) else selector
    return F.struct(F.lit(name).alias("field"), label.alias("selector"), matched.cast("int").alias("matched"))


def tried(name: str, steps: Sequence[tuple[str | Column, Column]]) -> Column:
    """The log of steps (label, count matched) up to the first that matched."""
    rows = F.array(*(hit(name, label, F.coalesce(n, F.lit(0))) for label, n in steps))
    won = F.array_position(F.transform(rows, lambda r: r["matched"] > 0), True)
    return F.when(won > 0, F.slice(rows, 1, won.cast("int"))).otherwise(rows).cast(HIT)
