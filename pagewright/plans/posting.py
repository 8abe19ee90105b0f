"""Pages to job postings: identity, layout, fields by ordered fallbacks, a log of what was tried, and the reason of a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import document_title, title_parts
from pagewright.functions.urls import guard, identity
from pagewright.operators import jsonld
from pagewright.operators.blocks import char_count
from pagewright.operators.fallback import HIT, field, pick, tried
from pagewright.operators.rules import Rule, read

#: Floors, selectors, labels of steps that aren't selectors, and patterns.
MIN_CHARS, MIN_BLOCKS = 300, 3
CHROME_HEADING = "about the job"
JSONLD = 'script[type="application/ld+json"]'
LAYOUTS = (
    ("sdui", "[data-sdui-screen]"), ("sdui", "[data-sdui-component]"), ("sdui", '[componentkey^="JobDetails_"]'),
    ("classic", ".job-details-jobs-unified-top-card__job-title"), ("classic", "#job-details"),
)
LISTED = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
SDUI_ROOTS = ('[data-sdui-screen$=".SemanticJobDetails"]', '[data-sdui-screen$=".JobDetails"]')
COMMON = 'nearest common ancestor of [componentkey^="JobDetails_"]'
CLASSIC_ROOTS = (".jobs-search__job-details", ".scaffold-layout__detail")
COMPONENT = "[data-sdui-component]"
BOX = '[data-testid="expandable-text-box"]'
SCOPED = '[componentkey="JobDetails_AboutTheJob_{job_id}"] ' + BOX
WORKPLACES = ("Remote", "Hybrid", "On-site")
WORKPLACE_WORD = r"(?a:\b)(Remote|Hybrid|On-site)(?a:\b)"
ID_PATH = r"/jobs/view/([0-9]+)"
#: Steps of each field by layout: (rule, label recorded, confidence), in order.
FIELDS: dict[str, dict[str, tuple[tuple[str, str, str], ...]]] = {
    "title": {
        "sdui": (
            ("title_text", "element outside [data-sdui-component] whose text = document.title segment 1", "high"),
            ("title_doc", "document.title segment 1", "low"),
        ),
        "classic": (("title_card", ".job-details-jobs-unified-top-card__job-title h1", "high"), ("title_t24", "h1.t-24", "high"), ("title_h1", "h1", "high")),
    },
    "company": {
        "sdui": (("company_link", 'a[href*="/company/"]', "high"), ("company_doc", "document.title segment 2", "low")),
        "classic": (("company_a", ".job-details-jobs-unified-top-card__company-name a", "high"), ("company_name", ".job-details-jobs-unified-top-card__company-name", "high")),
    },
    "location": {
        "sdui": (("location_span", "first span of the first p after the title containing ·, outside [data-sdui-component]", "medium"),),
        "classic": (
            ("location_1", ".job-details-jobs-unified-top-card__primary-description-container .tvm__text", "high"),
            ("location_2", ".job-details-jobs-unified-top-card__tertiary-description-container .tvm__text", "high"),
        ),
    },
}
JSONLD_LABELS = {"title": "jsonld JobPosting.title", "company": "jsonld JobPosting.hiringOrganization.name", "location": "jsonld JobPosting.jobLocation"}
BOXES = {
    "sdui": (("box_scoped", SCOPED), ("box_about", '[data-sdui-component$=".aboutTheJob"] ' + BOX), ("box_longest", BOX)),
    "classic": (
        ("box_details", "#job-details"),
        ("box_content", ".jobs-description__content .jobs-box__html-content"),
        ("box_html", ".jobs-box__html-content"),
        ("box_stretch", ".jobs-description-content__text--stretch"),
    ),
}
PANES = {
    "sdui": (("pane_key", 'digit suffix of [componentkey^="JobDetails_AboutTheJob_"]'),),
    "classic": (("pane_link", "job id in the top-card h1 link to /jobs/view/<id>"), ("pane_apply", "job id in .jobs-apply-button[data-job-id]")),
}
WORKPLACE = {
    "sdui": ("pill", "a/span outside [data-sdui-component] with text Remote, Hybrid, or On-site"),
    "classic": ("strong", ".job-details-fit-level-preferences button strong matching Remote, Hybrid, or On-site"),
}

RULES = (
    *(Rule(f"layout_{i}", s, scope="document") for i, (_, s) in enumerate(LAYOUTS)),
    *(Rule(f"sdui_root_{i}", s, scope="document") for i, s in enumerate(SDUI_ROOTS)),
    *(Rule(f"classic_root_{i}", s, scope="document") for i, s in enumerate(CLASSIC_ROOTS)),
    Rule("pane_key", '[componentkey^="JobDetails_AboutTheJob_"]', attr="componentkey", pattern=r"JobDetails_AboutTheJob_([0-9]+)\Z"),
    Rule("pane_link", '.job-details-jobs-unified-top-card__job-title h1 a[href*="/jobs/view/"]', attr="href", pattern=ID_PATH),
    Rule("pane_apply", ".jobs-apply-button[data-job-id]", attr="data-job-id"),
    *(Rule(name, s, pick="longest" if name == "box_longest" else "first") for steps in BOXES.values() for name, s in steps),
    Rule("title_text", "*", outside=COMPONENT, equals="segment"),
    *(Rule(name, s) for f in FIELDS.values() for name, s, _ in f["classic"]),
    Rule("company_link", 'a[href*="/company/"]', outside=COMPONENT, pick="text"),
    Rule("title_anchor", "*", outside=COMPONENT, equals="anchor"),
    Rule("location_span", "p", outside=COMPONENT, after="title_anchor", contains="·", sub="span"),
    Rule("pill", "a, span", outside=COMPONENT, pick="word", words=WORKPLACES),
    Rule("strong", ".job-details-fit-level-preferences button strong", pick="text", pattern=WORKPLACE_WORD),
)


def extract(pages: DataFrame, xml: bool = False) -> DataFrame:
    """pages (page_id, url, html) to (page_id, ok, failure, layout, url, pane_job_id, title, company, location, workplace_type, description, health).

    failure is the first reason of a fixed order; what comes after it in that order is null, what came before stays. Rows that
    repeat stay. Null URLs and pages are refused like bad ones; an empty table gives no rows.
    """
    ident = F.when(guard(F.col("url")), identity(F.col("url"))).otherwise(F.struct(F.lit("").alias("job_id"), F.lit("path").alias("source")))
    parts = title_parts(document_title(F.col("html")))
    rows = pages.select("page_id", guard(F.col("url")).alias("guarded"), ident.alias("url"), parts.alias("seg"), "html")
    rows = rows.select("*", F.col("url.job_id").alias("job_id"), F.col("seg.first").alias("segment"))
    # without a document title, the place is looked for after the element that has the title of the JSON-LD
    listed = F.filter(F.transform(F.regexp_extract_all("html", F.lit(LISTED), F.lit(1)), F.try_parse_json), lambda v: v.isNotNull())
    rows = rows.withColumn("anchor", F.when(F.col("segment") != "", F.col("segment")).otherwise(F.when(F.col("job_id") != "", jsonld.job(listed, F.col("job_id"), F.lit(""))["title"])))
    # sdui roots only scope sdui pages: on others no such element exists, and the page itself is the root
    rows = read(rows, RULES, SDUI_ROOTS, LAYOUTS[2][1], ("job_id", "segment", "anchor"), JSONLD, {lay: [r for r, _ in steps] for lay, steps in BOXES.items()}, xml)
    job_id = F.col("job_id")
    docs = F.filter(F.transform("scripts", F.try_parse_json), lambda v: v.isNotNull())
    rows = rows.withColumn("json", F.when(job_id != "", jsonld.job(docs, job_id, F.col("segment"))))

    def matched(rule: str) -> Column:
        return F.col("facts")[rule]["matched"]

    def value(rule: str) -> Column:
        if rule == "title_doc":
            return F.nullif(F.col("segment"), F.lit(""))
        if rule == "company_doc":
            return F.nullif(F.col("seg.second"), F.lit(""))
        return F.col("facts")[rule]["value"]

    def there(x: Column) -> Column:
        return x.isNotNull().cast("int")

    seen = F.array(*(F.coalesce(matched(f"layout_{i}"), F.lit(0)) > 0 for i in range(len(LAYOUTS))))
    rows = rows.withColumn("layout", F.get(F.array(*(F.lit(name) for name, _ in LAYOUTS)), F.nullif(F.array_position(seen, True), F.lit(0)).cast("int") - 1))
    sdui = F.col("layout") == "sdui"
    by = lambda make: F.when(sdui, make("sdui")).otherwise(make("classic"))
    rows = rows.withColumn("pane", by(lambda lay: F.coalesce(*(value(r) for r, _ in PANES[lay]))))

    def label(s: str) -> Column:
        return F.concat(F.lit(s.split("{job_id}")[0]), job_id, F.lit(s.split("{job_id}")[1])) if "{job_id}" in s else F.lit(s)

    def box(lay: str) -> Column:
        return F.coalesce(*(F.when(F.col("facts")[r]["pre"].isNotNull(), F.struct(label(s).alias("selector"))) for r, s in BOXES[lay]))

    rows = rows.withColumn("box", by(box))
    for name, steps in FIELDS.items():
        rows = rows.withColumn(name, by(lambda lay, steps=steps, name=name: pick([*(field(value(r), s, c) for r, s, c in steps[lay]), field(F.col("json")[name], JSONLD_LABELS[name], "low")])))
    words = by(lambda lay: value(WORKPLACE[lay][0]))
    rows = rows.withColumn("workplace_type", F.coalesce(F.when(words.isin(*WORKPLACES), words), F.lit("unknown")))
    early = (
        F.when(~F.col("guarded"), "not_linkedin_job")
        .when(job_id == "", "no_job_id")
        .when(F.col("layout").isNull() & F.col("json").isNull(), "unknown_layout")
        .when(F.col("layout").isNull(), "no_description")
        .when(~job_id.eqNullSafe(F.col("pane")), "stale_pane")
        .when(F.col("box").isNull(), "no_description")
    )
    rows = rows.withColumn("early", early)
    rows = rows.withColumn("blocks", F.when(F.col("early").isNull(), by(lambda lay: F.col("walked")[lay])))
    lead = F.get("blocks", F.lit(0))
    chrome = ~sdui & (lead["kind"] == "heading") & (F.lower(lead["text"]) == CHROME_HEADING)
    rows = rows.withColumn("blocks", F.when(chrome, F.slice("blocks", 2, F.size("blocks"))).otherwise(F.col("blocks"))).withColumn("chars", char_count(F.col("blocks")))

    failure = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("title").isNull(), "no_title")
        .when(sdui & (value("company_link") != value("company_doc")), "company_mismatch")
        .when((F.col("box.selector") == BOX) & (F.col("title.selector") == FIELDS["title"]["sdui"][1][1]), "low_confidence_fields")
        .when((F.col("chars") < MIN_CHARS) | (F.size("blocks") < MIN_BLOCKS), "description_too_short")
    )
    known = job_id != ""
    laid = known & F.col("layout").isNotNull()
    fresh = laid & (F.coalesce(F.col("early"), F.lit("")) != "stale_pane")
    boxed = F.col("early").isNull()
    titled = boxed & F.col("title").isNotNull()
    none = F.array().cast(HIT)

    def log(when: Column, *parts: Column) -> Column:
        return F.when(when, F.concat(*parts)).otherwise(none)

    def field_log(name: str) -> Column:
        def steps(lay: str) -> Column:
            each = [(s, there(value(r))) for r, s, _ in FIELDS[name][lay]]
            if lay == "sdui" and name == "title":  # without a document title the element can't be looked for
                return F.when(value("title_doc").isNotNull(), tried(name, each[:1])).otherwise(tried(name, each[1:]))
            if lay == "sdui" and name == "company":  # both are always read, to be compared
                return F.concat(tried(name, each[:1]), tried(name, each[1:]))
            return tried(name, each)

        used = F.coalesce(F.col(name)["selector"] == JSONLD_LABELS[name], F.lit(False))
        return F.concat(by(steps), log(used, tried(name, [(JSONLD_LABELS[name], F.lit(1))])))

    roots = {
        "sdui": [*((s, (matched(f"sdui_root_{i}") > 0).cast("int")) for i, s in enumerate(SDUI_ROOTS)), (COMMON, matched("layout_2"))],
        "classic": [(s, matched(f"classic_root_{i}")) for i, s in enumerate(CLASSIC_ROOTS)],
    }
    box_count = lambda r: matched(r) if r == "box_longest" else there(F.col("facts")[r]["pre"])
    place_count = {"sdui": there(value("pill")), "classic": matched("strong")}
    health = F.concat(
        log(known, tried("jsonld", [(JSONLD, there(F.col("json")))]), tried("layout", [(s, matched(f"layout_{i}")) for i, (_, s) in enumerate(LAYOUTS)])),
        log(laid, by(lambda lay: tried("detailRoot", roots[lay])), by(lambda lay: tried("paneJobId", [(s, there(value(r))) for r, s in PANES[lay]]))),
        log(fresh, by(lambda lay: tried("description", [(label(s), box_count(r)) for r, s in BOXES[lay]]))),
        log(boxed, field_log("title")),
        log(titled, field_log("company"), field_log("location"), by(lambda lay: tried("workplaceType", [(WORKPLACE[lay][1], place_count[lay])]))),
    )
    described = F.struct("blocks", F.col("chars").cast("int").alias("char_count"), F.col("box.selector").alias("selector"))
    return rows.select(
        "page_id",
        failure.isNull().alias("ok"),
        failure.alias("failure"),
        F.when(laid, F.col("layout")).when(known & F.col("json").isNotNull(), "jsonld").otherwise("unknown").alias("layout"),
        "url",
        F.when(laid, F.col("pane")).alias("pane_job_id"),
        F.when(boxed, F.col("title")).alias("title"),
        *(F.when(titled, F.col(c)).alias(c) for c in ("company", "location", "workplace_type")),
        F.when(boxed, described).alias("description"),
        health.alias("health"),
    )
