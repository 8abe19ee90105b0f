"""Which lines a question may point to: all, those of the sections that matter for the item's kind, or, where those are still too many, lines of the sections that a first question ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.decide import POINTERS

#: Sections that may be pointed to, and those that matter for a kind of item (for other kinds all do).
POINTED = ("summary", "roles", "education", "skills")
SECTIONS_OF = {
    "skill_or_tool": ("summary", "roles", "skills"),
    "experience": ("summary", "roles"),
    "education_or_certification": ("education", "skills"),
    "spoken_language": ("summary", "skills"),
    "collaboration_or_leadership": ("summary", "roles"),
}
ALL, RELEVANT, RANKED = "all", "relevant", "ranked"
NONE = "none"


def _relevant(kind: str = "kind", part: str = "part"):
    out = F.lit(True)
    for name, sections in SECTIONS_OF.items():
        out = F.when(F.col(kind) == name, F.col(part).isin(*sections)).otherwise(out)
    return out


def planned(lines: DataFrame, items: DataFrame, key: str, most: int = POINTERS) -> DataFrame:
    """(key, item, kind, way, section, n, first): for each item the sections that its question draws on, with their lines.

    lines: (key, line_no, section), where a section is one of POINTED or a part of it such as `roles[2]`; others are never
    pointed to. items: (key, item, kind). way is `all` where all lines fit one question, `relevant` where those of the kind's
    sections do, else `ranked`: a first question has the sections themselves as options. What is counted is a row for each
    section, so items meet sections, not lines. Where none of the kind's sections occurs, all count.
    An item whose key has no lines has one row without a section.
    """
    part = F.regexp_extract("section", r"\A[a-z]+", 0)
    sections = lines.withColumn("part", part).where(F.col("part").isin(*POINTED)).groupBy(key, "section", "part").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    rows = items.select(key, "item", "kind").join(sections, key, "left").withColumn("fits", F.coalesce(_relevant(), F.lit(True)))
    item = Window.partitionBy(key, "item")
    rows = rows.withColumn("fits", F.col("fits") | ~F.coalesce(F.bool_or(F.col("fits") & F.col("n").isNotNull()).over(item), F.lit(False)))
    total, relevant = F.sum("n").over(item), F.sum(F.when(F.col("fits"), F.col("n"))).over(item)
    way = F.when(F.coalesce(total, F.lit(0)) <= most, ALL).when(relevant <= most, RELEVANT).otherwise(RANKED)
    return rows.withColumn("way", way).where((F.col("way") == ALL) | F.col("fits")).select(key, "item", "kind", "way", "section", "n", "first")


def section_questions(plan: DataFrame, key: str) -> DataFrame:
    """(key, item, options) of the first pass: the sections in the order of the document, then `none`."""
    rows = plan.where(F.col("way") == RANKED).groupBy(key, "item").agg(F.array_sort(F.collect_list(F.struct("first", "section"))).alias("s"))
    return rows.select(key, "item", F.concat(F.transform("s", lambda s: s["section"]), F.array(F.lit(NONE))).alias("options"))


def line_options(lines: DataFrame, plan: DataFrame, ranked: DataFrame, key: str, most: int = POINTERS) -> DataFrame:
    """(key, item, way, nth, line_id) of the second, or only, pass: at most `most` lines, then `none`.

    ranked: (key, item, section, p), the first pass's answers; sections come by p, those without an answer last, ties by their
    place. Lines are in document order within a section, and what doesn't fit is cut off. No line beyond the first `most` of
    a section is sent on, and only those that fit meet an item.
    """
    plan = plan.join(ranked.select(key, "item", "section", "p"), [key, "item", "section"], "left")
    order = Window.partitionBy(key, "item").orderBy(F.when(F.col("way") == RANKED, F.col("p")).desc_nulls_last(), "first")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = plan.withColumn("before", before).where(F.col("before") < most)
    numbered = lines.withColumn("at", F.row_number().over(Window.partitionBy(key, "section").orderBy("line_no"))).where(F.col("at") <= most)
    found = placed.join(numbered.select(key, "section", "at", "line_id"), [key, "section"]).where(F.col("before") + F.col("at") <= most)
    found = found.select(key, "item", "way", (F.col("before") + F.col("at")).alias("nth"), "line_id")
    last = F.least(F.lit(most), F.coalesce(F.sum("n"), F.lit(0))) + 1
    none = plan.groupBy(key, "item", "way").agg(last.alias("nth")).withColumn("line_id", F.lit(NONE))
    return found.unionByName(none)
