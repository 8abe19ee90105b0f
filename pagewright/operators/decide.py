"""Verdicts from answers that carry probabilities, evidence, coverage, and the sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds and credits.
TOP, LOW, HIGH, POINTER, ROLE = 0.60, 0.30, 0.70, 0.15, 0.70
CREDIT = {"met": 1.0, "partial": 0.5, "not_shown": 0.0}
POINTERS = 254
LEVELS = 4
TOKENS_PER_REQUEST, CHARS_PER_TOKEN = 26_000, 3.5
USD_PER_TOKEN = 0.042e-6


def top_probability(probs: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(probs)), F.lit(0.0))


def choice(probs: Column) -> Column:
    """The label with the greatest probability; of several, the first by name."""
    best = F.array_max(F.map_values(probs))
    return F.array_min(F.transform(F.filter(F.map_entries(probs), lambda e: e["value"] == best), lambda e: e["key"]))


def settled(probs: Column, floor: float = TOP) -> Column:
    """The choice, or `unclassified` under the floor."""
    return F.when(top_probability(probs) >= floor, choice(probs)).otherwise("unclassified")


def expectation(probs: Column) -> Column:
    """Sum of level times probability."""
    return F.aggregate(F.map_entries(probs), F.lit(0.0), lambda z, e: z + e["key"].cast("double") * e["value"])


def verdict(coverage: Column, top: Column, evidenced: Column) -> Column:
    """The rules in order; `unclear` stands for can't tell. The band of the fourth rule is open."""
    return (
        F.when(coverage == "unclear", "unclear")
        .when(top < TOP, "unclear")
        .when((coverage.isin("met", "partial") & (evidenced < LOW)) | ((coverage == "not_shown") & (evidenced > HIGH)), "unclear")
        .when(coverage.isin("met", "not_shown") & (evidenced > LOW) & (evidenced < HIGH), "unclear")
        .otherwise(coverage)
    )


def verdict_reason(coverage: Column, top: Column, evidenced: Column) -> Column:
    split = F.when(coverage == "unclear", "ambiguous CV text").when(top < TOP, "split judgment")
    return F.coalesce(split, F.when(verdict(coverage, top, evidenced) != coverage, "checks disagree"))


def years_verdict(total: Column, minimum: Column, parsed: Column, uncertain: Column) -> Column:
    """From summed years; unparsed dates, or nothing but uncertain roles, are unclear."""
    return F.when(~parsed | uncertain, "unclear").when(total >= minimum, "met").when(total > 0, "partial").otherwise("not_shown")


def review_band(p: Column) -> Column:
    return p.between(LOW, HIGH)


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the union of each key's intervals; those that touch become one. Null bounds give none. Equal intervals are peers of one running sum, so their order can't matter."""
    rows = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def evidence(answers: DataFrame, key: str, probs: str, floor: float = POINTER) -> DataFrame:
    """(key, line_id, p, nth): lines with p >= floor, best first; none where `none` is the best answer."""
    rows = answers.select(key, choice(F.col(probs)).alias("_top"), F.explode(probs).alias("line_id", "p"))
    rows = rows.where((F.col("_top") != "none") & (F.col("line_id") != "none") & (F.col("p") >= floor))
    return rows.select(key, "line_id", "p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "line_id")).alias("nth"))


def needs_check(probs: Column, floor: float = POINTER) -> Column:
    """Whether an answer points to nothing that could be shown: `none` is its best, or no line reaches the floor."""
    lines = F.map_filter(probs, lambda k, p: (k != "none") & (p >= floor))
    return F.coalesce((choice(probs) == "none") | (F.size(lines) == 0), F.lit(True))


def trusted(pointers: DataFrame, existence: DataFrame, key: str) -> DataFrame:
    """pointers (key, probs) with `line_id`: the best line, trusted only where the answer (key, p) on whether there is one at all is an absolute yes."""
    rows = pointers.join(existence.select(key, F.col("p").alias("_there")), key, "left")
    best = choice(F.map_filter("probs", lambda k, p: k != "none"))
    return rows.withColumn("line_id", F.when(F.col("_there") > HIGH, best)).drop("_there")


def role_years(roles: DataFrame, key: str, start: str, end: str, p: str) -> DataFrame:
    """(key, years): the union of the ranges of roles that count, by an answer of ROLE at least; keys with none have 0."""
    counted = merged_intervals(roles.where(F.col(p) >= ROLE), key, start, end).groupBy(key).agg((F.sum(F.datediff(end, start)) / 365.25).alias("years"))
    return roles.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("years", F.lit(0.0)).alias("years"))


def crossings(runs: DataFrame, key: str, order: str, p: str) -> DataFrame:
    """(key, runs, crossed): the share of repeated answers that are on another side of the review band than the one before."""
    side = F.when(F.col(p) < LOW, 0).when(F.col(p) > HIGH, 2).otherwise(1)
    moved = side != F.lag(side).over(Window.partitionBy(key).orderBy(order))
    return runs.withColumn("_moved", moved).groupBy(key).agg(F.count("*").alias("runs"), F.try_divide(F.count_if("_moved").cast("double"), F.count("*") - 1).alias("crossed"))


def valid(expected: DataFrame, answered: DataFrame, request: str, question: str) -> DataFrame:
    """(request, missing, mistyped, ok) for expected (request, question, type) and answered (request, question, answer as JSON).

    A request is rejected whole if an expected question has no answer or one of another type: number, string, boolean,
    object or array.
    """
    kind = F.schema_of_variant(F.try_parse_json("answer"))
    named = (
        F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))
    )
    own = answered.select(request, question, named.alias("_kind"))
    rows = expected.join(own, [request, question], "left")
    rows = rows.groupBy(request).agg(F.count_if(F.col("_kind").isNull()).alias("missing"), F.count_if(F.col("_kind") != F.col("type")).alias("mistyped"))
    return rows.withColumn("ok", (F.col("missing") == 0) & (F.col("mistyped") == 0))


def coverage(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, credit, unclear, low, high): the range of required coverage; null without required items."""
    credit = F.lit(0.0)
    for name, value in CREDIT.items():
        credit = F.when(F.col("verdict") == name, value).otherwise(credit)
    found = verdicts.groupBy(*key).agg(F.count("*").alias("n"), F.sum(credit).alias("credit"), F.count_if(F.col("verdict") == "unclear").alias("unclear"))
    return found.withColumn("low", F.try_divide("credit", "n")).withColumn("high", F.try_divide(F.col("credit") + F.col("unclear"), F.col("n")))


def gaps(verdicts: DataFrame, key: str, item: str, most: int = 3) -> DataFrame:
    """The first gaps: required items that aren't shown, then unclear ones."""
    rank = F.when(F.col("verdict") == "not_shown", 0).when(F.col("verdict") == "unclear", 1)
    rows = verdicts.where(F.col("tier") == "required").withColumn("rank", rank).where("rank IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("rank", item))).where(F.col("nth") <= most)


def overlaid(rows: DataFrame, corrections: DataFrame, key: str, column: str, corrected: str) -> DataFrame:
    """rows with `original`, and `column` replaced where there is a correction; `is_corrected` says where. One correction a key."""
    own = corrections.select(key, F.col(corrected).alias("_own"))
    rows = rows.withColumn("original", F.col(column)).join(own, key, "left")
    return rows.withColumn(column, F.coalesce("_own", column)).withColumn("is_corrected", F.col("_own").isNotNull()).drop("_own")


def batches(sizes: Column, most: int) -> Column:
    """The request number of each size in order: a new request where the next would go over; an item too large is alone."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["no"] >= 0) & (s["used"] + n <= most)
        no = F.when(fits, s["no"]).otherwise(s["no"] + 1)
        return F.struct(F.when(fits, s["used"] + n).otherwise(n.cast("long")).alias("used"), no.alias("no"), F.concat(s["out"], F.array(no)).alias("out"))

    return F.aggregate(sizes, state, step, lambda s: s["out"])


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def request_key(*parts: Column) -> Column:
    """The cache key of a request: SHA-256 of its parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def complete(expected: DataFrame, answered: DataFrame, request: str, question: str) -> DataFrame:
    """(request, missing, ok): a request with any expected question unanswered is rejected whole."""
    missing = expected.join(answered, [request, question], "left_anti").groupBy(request).agg(F.count("*").alias("missing"))
    rows = expected.select(request).distinct().join(missing, request, "left").select(request, F.coalesce("missing", F.lit(0)).alias("missing"))
    return rows.withColumn("ok", F.col("missing") == 0)
