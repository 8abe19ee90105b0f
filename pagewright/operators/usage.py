"""How many tokens a request will take: from the ratio of tokens to characters that each route's requests have shown so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.decide import CHARS_PER_TOKEN

#: Requests of a route are summed up in order within spans of this length, then over spans.
SPAN = "hour"


def estimate(chars: Column, seen_chars: Column, seen_tokens: Column) -> Column:
    """Tokens for so many characters, by what has been seen, or by the fixed ratio before anything has."""
    seen = F.when((seen_chars > 0) & (seen_tokens > 0), chars * seen_tokens / seen_chars)
    return F.ceil(F.coalesce(seen, chars / CHARS_PER_TOKEN)).cast("long")


def estimated(requests: DataFrame, key: str, span: str = SPAN) -> DataFrame:
    """requests (key, route, at, chars, tokens) with `ratio`, tokens a character seen on the route before the request, and `estimate`.

    Requests at the same time are in the order of key. Those without tokens, such as failed ones, are estimated and teach
    nothing. Sums run within a span of time and over spans, so a route's whole past is never in one task.
    """
    rows = requests.withColumn("_span", F.date_trunc(span, "at"))
    known = F.col("tokens").isNotNull() & F.col("chars").isNotNull()
    sums = rows.where(known).groupBy("route", "_span").agg(F.sum("chars").alias("_c"), F.sum("tokens").alias("_t"))
    before = Window.partitionBy("route").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.select("route", "_span").distinct().join(sums, ["route", "_span"], "left")
    spans = spans.select(F.col("route").alias("_route"), F.col("_span").alias("_of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_c", "_t")))
    within = Window.partitionBy("route", "_span").orderBy("at", key).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, name: F.col(f"{name}0") + F.coalesce(F.sum(F.when(known, F.col(c))).over(within), F.lit(0))
    joined = rows.join(spans, F.col("route").eqNullSafe(F.col("_route")) & F.col("_span").eqNullSafe(F.col("_of")))
    rows = joined.withColumn("_chars", so_far("chars", "_c")).withColumn("_tokens", so_far("tokens", "_t"))
    rows = rows.withColumn("ratio", F.try_divide(F.col("_tokens").cast("double"), F.nullif("_chars", F.lit(0))))
    return rows.withColumn("estimate", estimate(F.col("chars"), F.col("_chars"), F.col("_tokens"))).drop("_span", "_route", "_of", "_c0", "_t0", "_chars", "_tokens")
