"""Building requests to a decision service, and what is done with them: selection, state, questions, edits, cache, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.privacy import leaks
from pagewright.operators.decide import HIGH, LOW, POINTERS, TOP, settled

#: Options, questions of an assessed item, and what an HTTP status means.
ELIGIBILITY = ("work_authorization", "location", "workplace_type", "relocation", "travel", "schedule", "salary", "clearance", "other")
TIERS = ("required", "preferred", "not_a_requirement")
KINDS = ("skill_or_tool", "experience", "education_or_certification", "spoken_language", "collaboration_or_leadership", "eligibility_or_logistics", "other")
STATE_SECTIONS = ("summary", "roles", "education", "skills", "other")
LEDGER = ("All", "Required", "Preferred", "Unclassified", "Eligibility", "Excluded")
ITEM_QUESTIONS = ("coverage", "evidenced", "strength", "where")
STATUS = ((401, "key error"), (402, "credit"), (403, "key error"), (408, "retry"), (429, "retry"), (500, "retry"), (502, "retry"), (503, "retry"), (504, "retry"))
#: A role's dates.
RANGE = r"(?:([A-Z][a-z]{2})[a-z]* )?([0-9]{4}) ?[–-] ?(?:(?:([A-Z][a-z]{2})[a-z]* )?([0-9]{4})|(Present))"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def unsettled(atoms: DataFrame) -> DataFrame:
    """Items whose tier is unknown or whose kind isn't settled: only those are asked about."""
    return atoms.where((F.col("tier") == "unknown") | F.col("kind").isNull())


def state(rows: DataFrame, key: str, id_: str, *fields: str) -> DataFrame:
    """(key, state): the rows of a key as a JSON object by id, in the order of ids."""
    entry = F.struct(F.col(id_).cast("string").alias("key"), F.struct(*fields).alias("value"))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return found.select(key, F.to_json(F.map_from_entries("e")).alias("state"))


def questions(items: DataFrame, id_: str, kinds: tuple[str, ...] = ITEM_QUESTIONS) -> DataFrame:
    """A row for each question of each item: (.., question, question_id)."""
    return items.withColumn("question", F.explode(F.array(*map(F.lit, kinds)))).withColumn("question_id", F.concat_ws("_", F.col(id_).cast("string"), "question"))


def job_questions(atoms: DataFrame, id_: str) -> DataFrame:
    """(.., question, question_id, options) of the first request.

    Tier and kind of each item that code couldn't settle, and its subtype, which is asked ahead of knowing whether it is
    wanted; of items that code has settled, the subtype of those of eligibility.
    """
    options = {"tier": TIERS, "kind": KINDS, "elig": ELIGIBILITY}
    each = F.array(*(F.struct(F.lit(q).alias("question"), F.array(*map(F.lit, o)).alias("options")) for q, o in options.items()))
    open_ = (F.col("tier") == "unknown") | F.col("kind").isNull()
    rows = atoms.where(open_ | (F.col("kind") == KINDS[5])).select("*", F.inline(each)).where(open_ | (F.col("question") == "elig"))
    return rows.withColumn("question_id", F.concat_ws("_", F.col(id_).cast("string"), "question"))


def classified(atoms: DataFrame, answers: DataFrame, id_: str) -> DataFrame:
    """atoms (id, tier, kind) with the first request's answers (id, question, probs) filled in, and `subtype`.

    What code has settled stays. A tier or kind whose best answer is under the floor is `unclassified`, or null for a kind. The
    subtype, asked of all, counts only for items that turn out to be of eligibility.
    """
    own = F.when(settled(F.col("probs")) != "unclassified", settled(F.col("probs")))
    rows = answers.groupBy(id_).agg(*(F.max(F.when(F.col("question") == q, own)).alias(f"_{q}") for q in ("tier", "kind", "elig")))
    rows = atoms.join(rows, id_, "left")
    kind = F.coalesce("kind", "_kind")
    tier = F.when(F.col("tier") == "unknown", F.coalesce("_tier", F.lit("unclassified"))).otherwise(F.col("tier"))
    return rows.withColumns({"tier": tier, "kind": kind}).withColumn("subtype", F.when(F.col("kind") == KINDS[5], F.coalesce("_elig", F.lit("other")))).drop("_tier", "_kind", "_elig")


def cv_state(lines: DataFrame, titles: DataFrame, key: str, foreign: DataFrame | None = None) -> DataFrame:
    """(key, state, refused): the state of the second request as JSON, job title and grouped lines with their ids; null where it is refused.

    lines: (key, line_no, line_id, section, text, header, private); titles: (key, title); foreign: (key, text) of the posting, of
    which nothing but the title may be sent. Only sections of STATE_SECTIONS are allowed. The first reason that holds refuses a
    key's state as a whole: `header`, `personal` (a private line, or any pattern of the sweep), `posting`, `section`. A key
    without lines has empty groups; one without a title has none sent.
    """
    section = F.col("section")
    part = F.when(section.isin(*STATE_SECTIONS), section)  # most sections are told without a pattern
    for name in STATE_SECTIONS:
        part = part.when(section.startswith(name + "["), name)
    part = part.otherwise(F.regexp_extract("section", r"\A[a-z]+", 0))
    inner = F.substring_index(F.substr(section, F.lit(len("roles[") + 1)), "]", 1)
    digits = section.startswith("roles[") & F.contains("section", F.lit("]")) & (F.translate(inner, "0123456789", "") == "")
    number = F.when(digits, inner).try_cast("int")
    bad = {
        "header": F.coalesce("header", F.lit(False)),
        "personal": F.coalesce("private", F.lit(False)) | F.coalesce(leaks(F.col("text")), F.lit(False)),
        "section": ~F.coalesce(F.col("part").isin(*STATE_SECTIONS), F.lit(False)),
    }
    rows = lines.withColumn("part", part)
    own = F.struct("line_no", "line_id", "text", "part", number.alias("role"), section.endswith("header").alias("h"))
    rows = rows.select(key, own.alias("_own"), F.lit(None).cast("string").alias("_foreign"), *(x.alias(f"_{n}") for n, x in bad.items()))
    if foreign is not None:  # a key's lines and its posting's texts meet in one shuffle
        texts = foreign.where(F.col(key).isNotNull() & (F.trim("text") != ""))
        rows = rows.unionByName(texts.select(key, F.col("text").alias("_foreign")), allowMissingColumns=True)
    found = rows.groupBy(key).agg(*(F.bool_or(f"_{n}").alias(f"_{n}") for n in bad), F.collect_list("_own").alias("_own"), F.collect_set("_foreign").alias("_foreign"))
    found = found.where(F.size("_own") > 0).withColumn("_posting", F.coalesce(F.arrays_overlap(F.transform("_own", lambda x: x["text"]), "_foreign"), F.lit(False)))
    line = lambda x: F.concat_ws(" ", x["line_id"], x["text"]).alias("l")
    of = lambda name, made: F.sort_array(F.transform(F.filter("_own", lambda x: x["part"] == name), made))
    texts_of = lambda name: F.transform(of(name, lambda x: F.struct(x["line_no"].alias("line_no"), line(x))), lambda x: x["l"])
    roles = of("roles", lambda x: F.struct(x["role"].alias("role"), x["line_no"].alias("line_no"), line(x), x["h"].alias("h")))
    found = found.select("*", *(texts_of(n).alias(n) for n in STATE_SECTIONS if n != "roles"), roles.alias("roles"))
    numbers = F.array_distinct(F.transform("roles", lambda r: r["role"]))
    texts = lambda n, h: F.transform(F.filter("roles", lambda r: r["role"].eqNullSafe(n) & (r["h"] == h)), lambda r: r["l"])
    grouped = F.transform(numbers, lambda n: F.struct(texts(n, True).alias("header"), texts(n, False).alias("lines")))
    refused = F.lit(None).cast("string")
    for name in ("section", "posting", "personal", "header"):
        refused = F.when(F.col(f"_{name}"), name).otherwise(refused)
    cv = F.struct("summary", grouped.alias("roles"), "education", "skills", "other")
    found = found.join(titles.select(key, "title"), key, "left").withColumn("refused", refused)
    return found.select(key, F.when(F.col("refused").isNull(), F.to_json(F.struct(F.col("title").alias("job_title"), cv.alias("cv")))).alias("state"), "refused")


def shown(items: DataFrame, choice: str) -> DataFrame:
    """The rows of a ledger (tier, kind, excluded) under one of its filters; each item is in one of the last five only."""
    excluded, eligibility = F.coalesce("excluded", F.lit(False)), F.coalesce(F.col("kind") == KINDS[5], F.lit(False))
    tests = {"All": F.lit(True), "Excluded": excluded, "Eligibility": eligibility & ~excluded}
    tests |= {name: (F.col("tier") == name.lower()) & ~excluded & ~eligibility for name in ("Required", "Preferred", "Unclassified")}
    return items.where(tests[choice])


def pointer_options(lines: DataFrame, key: str, wanted: Column, most: int = POINTERS) -> DataFrame:
    """lines (key, line_no) that may be pointed to, with `pass`: 1 where all wanted lines fit one question, else 2 (by section, then by line)."""
    rows = lines.where(wanted).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return rows.withColumn("pass", F.when(F.col("_n") <= most, 1).otherwise(2)).drop("_n")


def action(status: Column) -> Column:
    """What an HTTP status asks for."""
    out = F.when(status.between(200, 299), "use")
    for code, what in STATUS:
        out = out.when(status == code, what)
    return out.otherwise("reject")


def compared(declared: Column, required: Column, exact: Column) -> Column:
    """Eligibility: only exact values are compared; all else is the owner's call."""
    return F.when(~F.coalesce(exact, F.lit(False)) | declared.isNull() | required.isNull(), "Needs your call").when(declared == required, "Matches").otherwise("Conflict")


def reviewed(probability: Column, top: Column) -> Column:
    """Why an answer is to be reviewed, or null; one without a confidence always is."""
    return F.when(probability.isNull() | top.isNull(), "no confidence").when(probability.between(LOW, HIGH), "in the band").when(top < TOP, "split")


def usable(confidence: Column, cost: Column) -> Column:
    """What is done with a response: rejected without a cost, reviewed without a confidence."""
    return F.when(cost.isNull(), "reject").when(confidence.isNull(), "review").otherwise("use")


def role_requirements(roles: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """Each role of a key with each of its requirements of years (min_years): a question for each pair."""
    return roles.join(atoms.where("min_years IS NOT NULL"), key)


def composite(score: Column, levels: Column, weight: Column) -> tuple[Column, Column]:
    """Aggregates (weighted sum of scores normalised by their levels, sum of weights)."""
    return F.sum(weight * F.try_divide(score, levels - 1)), F.sum(weight)


def _last(edits: DataFrame, op: str, id_: str, *cols: str) -> DataFrame:
    """The edits of a kind, one an item: of several the last by `at` where edits have it, else the greatest by their values."""
    order = [F.col("at")] if "at" in edits.columns else []
    found = edits.where(F.col("op") == op).groupBy(id_).agg(F.max(F.struct(*order, *cols)).alias("_e"))
    return found.select(id_, *(F.col(f"_e.{c}").alias(f"_{c}") for c in cols))


def edited(items: DataFrame, edits: DataFrame, id_: str) -> DataFrame:
    """items (id, tier, text) under edits (id, op, tier, text[, at]): delete, set, split (text at `|`), add; each row says how it came about.

    Of several edits of one kind to an item the last by `at` holds; for `set`, tier and text each by themselves, so that edits
    of one leave the other. Without `at` the greatest value holds. A split item's parts have the tier that was set.
    """
    sets = edits.where(F.col("op") == "set")
    tiers, texts_ = (_last(sets.where(F.col(c).isNotNull()), "set", id_, c) for c in ("tier", "text"))
    splits = _last(edits, "split", id_, "text").select(id_, F.split("_text", r"\|").alias("_parts"))
    rows = items.join(edits.where(F.col("op") == "delete"), id_, "left_anti").join(tiers, id_, "left").join(texts_, id_, "left").join(splits, id_, "left")
    touched = F.coalesce("_tier", "_text").isNotNull()
    texts = F.coalesce(F.col("_parts"), F.array(F.coalesce("_text", "text")))
    rows = rows.select(
        id_,
        F.coalesce("_tier", "tier").alias("tier"),
        F.posexplode(texts).alias("part", "text"),
        F.when(F.col("_parts").isNotNull(), "split by you").when(touched, "edited by you").otherwise("read").alias("source"),
    )
    added = edits.where(F.col("op") == "add").select(id_, "tier", F.lit(0).alias("part"), "text", F.lit("added by you").alias("source"))
    return rows.unionByName(added)


def rearranged(items: DataFrame, edits: DataFrame, id_: str) -> DataFrame:
    """items (id, kind, text, pos) under edits (id, op, target, kind[, at]): `kind` sets it, `move` puts the item at position target, `merge` adds its text to that of the item target.

    Merged texts follow the target's own, in the order of their positions; what an item is merged into may itself be set or
    moved, but not merged. Of several edits of one kind to an item the last by `at` holds, without `at` the greatest value.
    `source` says what was done.
    """
    merges = _last(edits, "merge", id_, "target").withColumnRenamed("_target", "_into")
    merged = items.join(merges, id_).groupBy("_into")
    merged = merged.agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_more")).withColumnRenamed("_into", id_)
    rows = items.join(merges, id_, "left_anti").join(_last(edits, "kind", id_, "kind"), id_, "left")
    rows = rows.join(_last(edits, "move", id_, "target").withColumnRenamed("_target", "_pos"), id_, "left").join(merged, id_, "left")
    parts = F.concat(F.array("text"), F.coalesce(F.transform("_more", lambda m: m["text"]), F.array().cast("array<string>")))
    done = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), what) for c, what in (("_more", "merged by you"), ("_kind", "edited by you"), ("_pos", "moved by you")))))
    return rows.select(
        id_,
        F.coalesce("_kind", "kind").alias("kind"),
        F.array_join(parts, " ").alias("text"),
        F.coalesce("_pos", "pos").alias("pos"),
        F.when(F.size(done) > 0, F.array_join(done, ", ")).otherwise("read").alias("source"),
    )


def to_ask(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests whose key isn't cached."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def affected(asked: DataFrame, changed: DataFrame, item: str) -> DataFrame:
    """Questions on items that a correction has changed: only those are asked again."""
    return asked.join(changed.select(item).distinct(), item, "left_semi")


def stale(results: DataFrame) -> Column:
    """Whether a shown result is of another job than the page's."""
    return ~F.col("job_id").eqNullSafe(F.col("page_job_id"))


def date_range(text: Column) -> Column:
    """(start, stop, parsed) of a role's dates; a missing month is January, at the end December; null stop for the present."""
    part = lambda i: F.nullif(F.regexp_extract(text, RANGE, i), F.lit(""))

    def day(month: Column, year: Column, default: int) -> Column:
        n = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month), F.lit(0)), F.when(month.isNull(), F.lit(default)))
        return F.try_make_date(year.cast("int"), n.cast("int"), F.lit(1)) if hasattr(F, "try_make_date") else F.when(n.isNotNull(), F.make_date(year.cast("int"), n.cast("int"), F.lit(1)))

    start = day(part(1), part(2), 1)
    stop = F.when(part(5).isNull(), F.last_day(day(part(3), part(4), 12)))
    parsed = start.isNotNull() & (stop.isNotNull() | part(5).isNotNull())
    return F.struct(start.alias("start"), stop.alias("stop"), parsed.alias("parsed"))


def headline(found: DataFrame) -> Column:
    """The sentence of counts; columns met, partial, unclear, n, gap."""
    first = F.format_string("Your CV shows evidence for %d of %d required items (%d partly).", "met", "n", "partial")
    unclear = F.when(F.col("unclear") > 0, F.format_string(" %d can't be judged from the CV.", "unclear")).otherwise("")
    return F.concat(first, unclear, F.coalesce(F.concat(F.lit(" Top gap: "), F.col("gap").cast("string"), F.lit(".")), F.lit("")))
