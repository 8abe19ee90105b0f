"""Many known strings found in many lines: by an index of each string's rarest piece, so that no string is tried on every line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.privacy import remove_strings

#: Characters of the longest piece; a string's pieces are of the greatest power of two up to this that it is as long as.
PIECE = 16
#: Characters of a piece's beginning, by which a line's pieces are sifted before they are moved.
LEAD = 4
#: Indexes are broadcast up to so many rows; beyond, lines' pieces are shuffled.
BROADCAST_ROWS = 200_000


def pieces(x: Column, size: int = PIECE) -> Column:
    """The runs of `size` characters of a text, read off at every place, in time that grows with its length."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _sized(index: DataFrame, number: int) -> DataFrame:
    return F.broadcast(index) if number <= BROADCAST_ROWS else index


def _met(rows: DataFrame, strings: DataFrame, on: list[str]) -> DataFrame | None:
    """(_id, _met): for each id of rows (_id, text, on) that holds any string's rarest piece, those strings; none without strings."""
    known = strings.where(F.coalesce(F.col("string") != "", F.lit(False))).select(*on, "string").distinct()
    length = F.char_length("string")
    classes = [2**i for i in range(PIECE.bit_length())]
    size = F.lit(1)
    for n in classes[1:]:
        size = F.when(length >= n, n).otherwise(size)
    sizes = sorted(r[0] for r in known.select(size.alias("n")).distinct().collect())  # PIECE's powers of two at most
    if not sizes:
        return None
    own = F.lit(None).cast("array<string>")
    for n in sizes:
        own = F.when(size == n, pieces(F.col("string"), n)).otherwise(own)
    parts = known.select(*on, "string", F.explode(F.array_distinct(own)).alias("piece"))
    counts = parts.groupBy(*on, "piece").agg(F.count("*").alias("times"))
    rarest = parts.join(counts, [*on, "piece"]).groupBy(*on, "string").agg(F.min(F.struct("times", "piece")).alias("r"))
    index = rarest.select(*on, F.col("r.piece").alias("piece"), "string")
    lead = F.substring("piece", 1, LEAD)
    leads = index.select(lead.alias("_lead")).distinct()
    number, first = known.count(), leads.limit(BROADCAST_ROWS + 1).count()
    met = rows.where("text IS NOT NULL").select("_id", *on, F.explode(F.array_distinct(F.flatten(F.array(*(pieces(F.col("text"), n) for n in sizes))))).alias("piece"))
    if first <= BROADCAST_ROWS:
        met = met.withColumn("_lead", lead).join(F.broadcast(leads), "_lead", "left_semi").drop("_lead")
    return met.join(_sized(index, number), [*on, "piece"]).groupBy("_id").agg(F.collect_set("string").alias("_met"))


def _marked(lines: DataFrame, strings: DataFrame, id_: list[str], key: str | None) -> DataFrame:
    """lines with `_found`, the strings that occur in each. Texts are moved once, to what their pieces met, never with each piece."""
    on = [key] if key else []
    rows = lines.withColumn("_id", F.struct(*dict.fromkeys([*id_, *on])))  # a null in an id is a value like any other
    met = _met(rows.select("_id", "text", *on), strings, on)
    if met is None:
        return lines.withColumn("_found", F.array().cast("array<string>"))
    known = F.filter("_met", lambda s: F.contains(F.col("text"), s))
    return rows.join(met, "_id", "left").withColumn("_found", F.coalesce(known, F.array().cast("array<string>"))).drop("_id", "_met")


def found(lines: DataFrame, strings: DataFrame, id_: list[str], key: str | None = None) -> DataFrame:
    """(id, string) of the strings that occur in lines, as they stand, anywhere in a text.

    lines: (id columns, text); strings: (string), and with key both have that column and must agree on it. Null and empty
    strings aren't looked for. Each string is indexed by the one of its pieces that the fewest strings have; a line looks up its
    own pieces, and what it meets is then compared in full.
    """
    rows = lines.select(*dict.fromkeys([*id_, *([key] if key else [])]), "text")
    return _marked(rows, strings, id_, key).select(*id_, F.explode("_found").alias("string")).distinct()


def without(lines: DataFrame, strings: DataFrame, id_: list[str], key: str | None = None) -> DataFrame:
    """lines with `removed`, how many of the strings each had, and their text without them, longest first; id names a line."""
    rows = _marked(lines, strings, id_, key)
    text = F.when(F.size("_found") > 0, remove_strings(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    return rows.withColumn("removed", F.size("_found")).withColumn("text", text).drop("_found")
