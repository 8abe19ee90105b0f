"""Requirement statements: section tiers, cues, years, routing to eligibility or exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import first_capture, split_sentences

#: Headings by tier, cues by tier, keywords of eligibility and of protected attributes.
HEADINGS = {
    "required": (
        "requirements", "qualifications", "minimum qualifications", "basic qualifications", "what you'll bring", "what you bring", "you have", "must have", "who you are",
        "skills and experience",
    ),
    "preferred": ("nice to have", "preferred qualifications", "bonus", "pluses", "bonus points", "it would be great if"),
    "not_a_requirement": (
        "about the role", "about us", "about the company", "responsibilities", "what you'll do", "the role", "benefits", "what we offer", "perks", "our values",
        "equal opportunity", "eeo",
    ),
}
CUES = (("preferred", r"a plus|nice to have|preferred|bonus|ideally"), ("required", r"must|required|minimum|at least"))
ELIGIBILITY = r"visa|sponsorship|authorized to work|citizenship|clearance|relocate|on-site in|located in|salary|travel [0-9]+ ?%|[0-9]+ ?% travel|shift"
PROTECTED = r"age limit|years old|gender|marital status|nationality"
DEGREES = r"bachelor|master|ph\.?d|diploma|degree"
CERTIFICATES = r"certified|certification|certificate"
YEARS = r"([0-9]+)\+?[ \t]*(?:years|yrs)"
WARN, CAP = 30, 40


def word(x: Column, pattern: str) -> Column:
    """Whether any alternative occurs as whole words, whatever the case."""
    return F.lower(x).rlike(rf"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])")


def heading_key(x: Column) -> Column:
    """A heading as the dictionary has it: lower case, straight apostrophes, no colon at the end."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("’"), F.lit("'")), r":+$", ""))


def heading_tiers(spark: SparkSession) -> DataFrame:
    """(heading, section_tier): a table of a fixed few rows."""
    return spark.createDataFrame([(h, tier) for tier, known in HEADINGS.items() for h in known], "heading string, section_tier string")


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, pos, kind, text) with `section` (its heading's pos, null above the first) and `heading`; headings are left out."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("kind") == "heading"
    found = blocks.withColumn("section", F.last_value(F.when(is_head, F.col("pos")), True).over(before)).withColumn("heading", F.last_value(F.when(is_head, F.col("text")), True).over(before))
    return found.where(~is_head)


def split_atoms(sectioned: DataFrame, key: str) -> DataFrame:
    """(key, section, heading, pos, part, text): the bullets of a section; where it has none, the sentences of its paragraphs."""
    own = Window.partitionBy(key, "section")
    rows = sectioned.withColumn("bullets", F.max((F.col("kind") == "bullet").cast("int")).over(own)).where((F.col("bullets") == 0) | (F.col("kind") == "bullet"))
    parts = F.when(F.col("kind") == "bullet", F.array("text")).otherwise(split_sentences(F.col("text")))
    return rows.select(key, "section", "heading", "pos", F.posexplode(parts).alias("part", "text"))


def classify(atoms: DataFrame) -> DataFrame:
    """atoms (heading, text, ...) with tier, tier_source, kind_hint, min_years, phrase, degree, certificate. A cue beats the heading."""
    tiers = F.broadcast(heading_tiers(atoms.sparkSession))
    rows = atoms.withColumn("_key", heading_key(F.col("heading"))).join(tiers.withColumnRenamed("heading", "_key"), "_key", "left").drop("_key")
    text = F.col("text")
    cue = F.lit(None).cast("string")
    for tier, pattern in reversed(CUES):
        cue = F.when(word(text, pattern), tier).otherwise(cue)
    return (
        rows.withColumn("tier", F.coalesce(cue, F.col("section_tier"), F.lit("unknown")))
        .withColumn("tier_source", F.when(cue.isNotNull(), "cue").when(F.col("section_tier").isNotNull(), "heading"))
        .withColumn("route", F.when(word(text, PROTECTED), "excluded").when(word(text, ELIGIBILITY), "eligibility").otherwise("assessed"))
        .withColumn("min_years", first_capture(F.lower(text), YEARS).cast("int"))
        .withColumn("phrase", F.nullif(F.trim(F.regexp_extract(text, rf"(?i){YEARS}(?: of)?(?: experience)?(?: (?:with|in))?([^.,;]*)", 2)), F.lit("")))
        .withColumn("degree", word(text, DEGREES))
        .withColumn("certificate", word(text, CERTIFICATES))
        .drop("section_tier")
    )


def numbered(atoms: DataFrame, key: str) -> DataFrame:
    """atoms with atom_no, atom_id (a01, a02, ...), `warned` (more than WARN) and `active` (among the first CAP): none is dropped."""
    order = Window.partitionBy(key).orderBy("pos", "part")
    rows = atoms.withColumn("atom_no", F.row_number().over(order)).withColumn("atoms", F.count("*").over(Window.partitionBy(key)))
    return rows.withColumn("atom_id", F.format_string("a%02d", "atom_no")).withColumn("warned", F.col("atoms") > WARN).withColumn("active", F.col("atom_no") <= CAP).drop("atoms")
