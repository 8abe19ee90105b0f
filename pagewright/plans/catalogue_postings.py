"""Job postings read from pages that are made of a few templates around the rows of the pages table, against what the templates say.

Every reason of a refusal, both layouts, and each way to a field occurs; ids, names and lengths come from the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import jsonld
from pagewright.plans.catalogue import query, table
from pagewright.plans.posting import extract

_BODY = "<p>{words}</p><ul><li>first of all</li><li>second</li></ul>"
_SHORT = "<p>brief</p>"
_LD = '<script type="application/ld+json">{{"@type":"JobPosting","title":"Listed {n}","identifier":{{"value":"{id}"}},"hiringOrganization":{{"name":"House {n}"}}}}</script>'


def _sdui(body: str = _BODY, key: str = "{id}", doc: str = "(3) Role {n} | Firm {n} | Site", firm: str = "Firm {n}", screen: bool = True, box: bool = True, more: str = "") -> str:
    where = ' data-sdui-screen="a.SemanticJobDetails"' if screen else ""
    inner = f'<div data-testid="expandable-text-box">{body}</div>' if box else ""
    return (
        f"<html><head><title>{doc}</title>{more}</head><body><main><div{where}><a href='/company/7'>{firm}</a><h1>Role {{n}}</h1><p><span>Port {{n}}</span> \u00b7 new</p><span>Remote</span>"
        f'<div data-sdui-component="x.aboutTheJob" componentkey="JobDetails_AboutTheJob_{key}">{inner}</div></div></main></body></html>'
    )


def _classic(title: str = "h1", key: str = "{id}", more: str = "") -> str:
    return (
        f'<div class="job-details-jobs-unified-top-card__job-title"><{title}><a href="/jobs/view/{key}/">Role {{n}}</a></{title}></div><div class="job-details-jobs-unified-top-card__company-name"><a>Firm {{n}}</a></div>'
        f'<div class="job-details-jobs-unified-top-card__primary-description-container"><span class="tvm__text">Port {{n}}</span></div>'
        f'<div class="job-details-fit-level-preferences"><button><strong>Hybrid</strong></button></div>{more}<div id="job-details"><h2>About the Job</h2>{_BODY}</div>'
    )


_JOB = "https://www.linkedin.com/jobs/view/{id}/"
_LOW = _sdui(doc="Elsewhere | Firm {n} | Site").replace('<div data-testid', '<i></i></div><div data-testid').replace("x.aboutTheJob", "x.other")
#: (URL, page, what is expected: failure, layout, title and company (with their confidence), location, workplace, blocks)
CASES = (
    (_JOB, _sdui(), (None, "sdui", "Role", "high", "Firm", "high", "Port", "Remote", 3)),
    ("https://www.linkedin.com/jobs/search/?currentJobId={id}", _sdui(screen=False), (None, "sdui", "Role", "high", "Firm", "high", "Port", "Remote", 3)),
    (_JOB, _classic(), (None, "classic", "Role", "high", "Firm", "high", "Port", "Hybrid", 3)),
    ("https://example.com/jobs/view/{id}/", _sdui(), ("not_linkedin_job", "unknown", None, None, None, None, None, None, None)),
    ("https://www.linkedin.com/jobs/collections/", _sdui(), ("no_job_id", "unknown", None, None, None, None, None, None, None)),
    (_JOB, "<h1>Role {n}</h1>", ("unknown_layout", "unknown", None, None, None, None, None, None, None)),
    (_JOB, _LD, ("no_description", "jsonld", None, None, None, None, None, None, None)),
    (_JOB, _sdui(key="9{id}"), ("stale_pane", "sdui", None, None, None, None, None, None, None)),
    (_JOB, _classic(key="9{id}"), ("stale_pane", "classic", None, None, None, None, None, None, None)),
    (_JOB, _sdui(box=False), ("no_description", "sdui", None, None, None, None, None, None, None)),
    (_JOB, _classic("h6", more='<button class="jobs-apply-button" data-job-id="{id}">Apply</button>'), ("no_title", "classic", None, None, None, None, None, None, 3)),
    (_JOB, _sdui(firm="Rival {n}"), ("company_mismatch", "sdui", "Role", "high", "Rival", "high", "Port", "Remote", 3)),
    (_JOB, _LOW, ("low_confidence_fields", "sdui", "Elsewhere", "low", "Firm", "high", "Port", "Remote", 3)),
    (_JOB, _sdui(_SHORT), ("description_too_short", "sdui", "Role", "high", "Firm", "high", "Port", "Remote", 1)),
    (_JOB, _sdui(doc=" ", firm="", more=_LD), (None, "sdui", "Listed", "low", "House", "low", "Port", "Remote", 3)),
)
#: Fixed names that stand without the row's number.
_BARE = ("Elsewhere",)


def _filled(template: str, n: Column, id_: Column, words: Column) -> Column:
    """The template with the row's values in place of its fields."""
    parts: list[Column] = []
    rest = template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        before, found, after = rest.partition("{")
        parts.append(F.lit(before.replace("\0", "{").replace("\1", "}")))
        name, _, rest = after.partition("}")
        if found:
            parts.append({"n": n, "id": id_, "words": words}[name])
    return F.concat(*parts)


def made_pages(spark, d) -> DataFrame:
    """(page_id, url, html): one of CASES for each row of pages."""
    page = F.col("page_id")
    n, id_ = (page % 17).cast("string"), (100000 + page).cast("string")
    words = F.concat(F.repeat(F.lit("word "), (60 + page % 40).cast("int")), F.lit("end"))
    pick = lambda i: F.get(F.array(*(_filled(c[i], n, id_, words) for c in CASES)), (page % len(CASES)).cast("int"))
    return table(spark, d, "pages").select("page_id", pick(0).alias("url"), pick(1).alias("html"))


def _case(values, kind: str = "VARCHAR") -> str:
    quoted = ("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" if kind != "named" or v in _BARE else f"'{v} ' || page_id % 17" for v in values)
    return f"CASE page_id % {len(CASES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def _expected(i: int) -> list:
    return [c[2][i] for c in CASES]


_CHARS = "CAST(CASE WHEN n = 3 THEN 5 * (60 + page_id % 40) + 3 + 12 + 6 WHEN n = 1 THEN 5 END AS INT)"
_SQL = f"""SELECT page_id, failure IS NULL AS ok, failure, layout, pane_job_id, title, title_confidence, company, company_confidence, location, workplace_type,
  CAST(n AS INT) AS n_blocks, {_CHARS} AS char_count FROM (SELECT page_id, {_case(_expected(0))} AS failure, {_case(_expected(1))} AS layout,
  CASE WHEN page_id % {len(CASES)} IN (7, 8) THEN '9' || (100000 + page_id) WHEN page_id % {len(CASES)} IN (3, 4, 5, 6) THEN NULL ELSE CAST(100000 + page_id AS VARCHAR) END AS pane_job_id,
  {_case(_expected(2), "named")} AS title, {_case(_expected(3))} AS title_confidence, {_case(_expected(4), "named")} AS company, {_case(_expected(5))} AS company_confidence,
  {_case(_expected(6), "named")} AS location, {_case(_expected(7))} AS workplace_type, {_case(_expected(8))} AS n FROM pages)"""


@query(_SQL)
def job_postings(spark, d):
    """The reading of job pages from end to end."""
    found = extract(made_pages(spark, d))
    return found.select(
        "page_id", "ok", "failure", "layout", "pane_job_id", F.col("title.value").alias("title"), F.col("title.confidence").alias("title_confidence"),
        F.col("company.value").alias("company"), F.col("company.confidence").alias("company_confidence"), F.col("location.value").alias("location"),
        "workplace_type", F.size("description.blocks").alias("n_blocks"), F.col("description.char_count").alias("char_count"),
    )


@query(f"SELECT coalesce(failure, 'ok') AS failure, layout, count(*) AS pages, CAST(sum(char_count) AS BIGINT) AS chars FROM ({_SQL}) GROUP BY 1, 2")
def job_failures(spark, d):
    """Pages by layout and reason of refusal."""
    found = extract(made_pages(spark, d)).select(F.coalesce("failure", F.lit("ok")).alias("failure"), "layout", F.col("description.char_count").alias("chars"))
    return found.groupBy("failure", "layout").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 2 THEN 'Inner ' || c_custkey END AS title,
  CASE WHEN c_custkey % 4 <> 2 THEN 'House ' || c_nationkey END AS company, CASE WHEN c_custkey % 4 <> 2 THEN 'Port, ' || c_nationkey END AS location FROM customer""")
def json_graphs(spark, d):
    """The posting that names the customer's number, below up to 60 graphs (first kind), arrays (second) or both in turn (fourth) after one of another number; the third kind has only that.

    In the fourth kind what holds the graph is such a posting itself, and what the graph holds comes first.
    """
    rows = table(spark, d, "customer")
    key, nation, deep = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 60).cast("int")
    kind = F.col("c_custkey") % 4

    def posting(title: str, id_: Column) -> Column:
        place = F.concat(F.lit('"jobLocation":[{"address":{"addressLocality":"Port","addressCountry":"'), nation, F.lit('"}}]'))
        house = F.concat(F.lit('"hiringOrganization":{"name":"House '), nation, F.lit('"}'))
        return F.concat(F.lit('"@type":["Thing","JobPosting"],"title":"' + title + " "), key, F.lit('","identifier":"'), id_, F.lit('",'), house, F.lit(","), place)

    wrong, right = (F.concat(F.lit("{"), posting(t, i), F.lit("}")) for t, i in (("Other", F.lit("none")), ("Inner", key)))
    inside = F.when(kind == 2, wrong).otherwise(F.concat(wrong, F.lit(","), right))
    first, last = ('{"@graph":[', "]}"), ("[", "]")
    wrapped = lambda x, *ways: F.concat(*(F.repeat(F.lit(w[0]), deep) for w in ways), F.lit("["), x, F.lit("]"), *(F.repeat(F.lit(w[1]), deep) for w in reversed(ways)))
    outer = F.concat(F.lit("{"), posting("Outer", key), F.lit(',"@graph":'), wrapped(inside, first, last), F.lit("}"))
    text = F.when(kind == 1, wrapped(inside, last)).when(kind == 3, outer).otherwise(wrapped(inside, first))
    found = rows.select("c_custkey", jsonld.job(F.array(F.try_parse_json(text)), key, F.lit("")).alias("job"))
    return found.select("c_custkey", "job.title", "job.company", "job.location")


# --- every step of every field, on pages with decoys outside the root and beside what is looked for

_FULL = "<p>{words}</p><p>second</p><ul><li>third<ul><li>fourth</li></ul></li></ul>"
_BOX = '<div data-testid="expandable-text-box">'
_OTHER = _BOX + "other " * 200 + "</div>"
_DECOYS = '<a href="/company/0">Decoy</a><p><span>Nowhere</span> · old</p><span>Hybrid</span>' + _OTHER
_LISTING = '<script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":"JobPosting","title":"Listed {n}","url":"https://x/{id}","hiringOrganization":{{"name":"House {n}"}},"jobLocation":"Bay {n}"}}]</script>'
_ABOUT = f'<div data-sdui-component="x.aboutTheJob" componentkey="JobDetails_AboutTheJob_{{id}}">{_BOX}{_FULL}</div></div>'
_KEY = '<div componentkey="JobDetails_AboutTheJob_{id}"></div>'


def _step(head: str = "<title>(3) Role {n} | Firm {n} | Site</title>", root: str = ' data-sdui-screen="a.SemanticJobDetails"', firm: str = "Firm {n}", role: str = "Role {n}", early: str = "Early", place: str = "Port {n}", pill: str = "On-site", boxes: str = _ABOUT, last: str = "") -> str:
    card = f'<a href="/company/7">{firm}</a><p><span>{early}</span> · at</p><h1>{role}</h1><p>no place</p><p><span>{place}</span> · new</p><a>{pill}</a>'
    return f"<head>{head}</head><body>{_DECOYS}<main><div{root}>{card}{boxes}</div></main>{last}</body>"


def _old_step(parts: str, box: str = '<div id="job-details"><h2>About the Job</h2>' + _FULL + "</div>") -> str:
    return f"<title>Jobs</title><div>{parts}</div>{box}"


_LINK = '<div class="job-details-jobs-unified-top-card__job-title"><h1><a href="/jobs/view/{id}/">Role {n}</a></h1></div>'
_MARK = '<b class="job-details-jobs-unified-top-card__job-title"></b>'
_PRIMARY = '<div class="job-details-jobs-unified-top-card__primary-description-container"><span class="tvm__text">Port {n}</span><span class="tvm__text">more</span></div>'
_TERTIARY = '<div class="job-details-jobs-unified-top-card__tertiary-description-container"><span class="tvm__text">{place} {n}</span></div>'
_APPLY = '<button class="jobs-apply-button" data-job-id="{id}">Apply</button>'
_FIT = '<div class="job-details-fit-level-preferences"><button><strong>{first}</strong></button><button><strong>Is Hybrid, or so</strong></button></div>'
#: The labels of the steps in the log, under short names.
LABELS = {
    "j1": ("jsonld", 'script[type="application/ld+json"]'),
    "l1": ("layout", "[data-sdui-screen]"),
    "l2": ("layout", "[data-sdui-component]"),
    "l3": ("layout", '[componentkey^="JobDetails_"]'),
    "l4": ("layout", ".job-details-jobs-unified-top-card__job-title"),
    "l5": ("layout", "#job-details"),
    "r1": ("detailRoot", '[data-sdui-screen$=".SemanticJobDetails"]'),
    "r2": ("detailRoot", '[data-sdui-screen$=".JobDetails"]'),
    "r3": ("detailRoot", 'nearest common ancestor of [componentkey^="JobDetails_"]'),
    "r4": ("detailRoot", ".jobs-search__job-details"),
    "r5": ("detailRoot", ".scaffold-layout__detail"),
    "k1": ("paneJobId", 'digit suffix of [componentkey^="JobDetails_AboutTheJob_"]'),
    "k2": ("paneJobId", "job id in the top-card h1 link to /jobs/view/<id>"),
    "k3": ("paneJobId", "job id in .jobs-apply-button[data-job-id]"),
    "d1": ("description", '[componentkey="JobDetails_AboutTheJob_{id}"] [data-testid="expandable-text-box"]'),
    "d2": ("description", '[data-sdui-component$=".aboutTheJob"] [data-testid="expandable-text-box"]'),
    "d3": ("description", '[data-testid="expandable-text-box"]'),
    "d4": ("description", "#job-details"),
    "d5": ("description", ".jobs-description__content .jobs-box__html-content"),
    "d6": ("description", ".jobs-box__html-content"),
    "d7": ("description", ".jobs-description-content__text--stretch"),
    "t1": ("title", "element outside [data-sdui-component] whose text = document.title segment 1"),
    "t2": ("title", "document.title segment 1"),
    "t3": ("title", ".job-details-jobs-unified-top-card__job-title h1"),
    "t4": ("title", "h1.t-24"),
    "t5": ("title", "h1"),
    "t6": ("title", "jsonld JobPosting.title"),
    "c1": ("company", 'a[href*="/company/"]'),
    "c2": ("company", "document.title segment 2"),
    "c3": ("company", ".job-details-jobs-unified-top-card__company-name a"),
    "c4": ("company", ".job-details-jobs-unified-top-card__company-name"),
    "c5": ("company", "jsonld JobPosting.hiringOrganization.name"),
    "p1": ("location", "first span of the first p after the title containing ·, outside [data-sdui-component]"),
    "p2": ("location", ".job-details-jobs-unified-top-card__primary-description-container .tvm__text"),
    "p3": ("location", ".job-details-jobs-unified-top-card__tertiary-description-container .tvm__text"),
    "p4": ("location", "jsonld JobPosting.jobLocation"),
    "w1": ("workplaceType", "a/span outside [data-sdui-component] with text Remote, Hybrid, or On-site"),
    "w2": ("workplaceType", ".job-details-fit-level-preferences button strong matching Remote, Hybrid, or On-site"),
}
#: (page, title, company and location, each by its step; workplace, step of the description, what was tried with what it matched)
STEP_CASES = (
    (_step(), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=1 r1=1 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(root=' data-sdui-screen="a.JobDetails"', last='<div data-sdui-screen="b.Other"></div>'), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=2 r1=0 r2=1 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(root="", boxes=f'<div componentkey="JobDetails_AboutTheJob_{{id}}">{_BOX}{_FULL}</div></div><i componentkey="JobDetails_Other_9"></i>'), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=0 l2=0 l3=2 r1=0 r2=0 r3=2 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(root=""), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=0 l2=1 r1=0 r2=0 r3=1 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(boxes=_ABOUT.replace("x.aboutTheJob", "x.other") + f'<div componentkey="JobDetails_AboutTheJob_9{{id}}" data-sdui-component="x.aboutTheJob">{_OTHER}</div>'), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=1 r1=1 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(boxes=_KEY + f'<div data-sdui-component="x.aboutTheJob" componentkey="JobDetails_AboutTheJob_9{{id}}">{_OTHER}</div>' + _ABOUT), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d1", "j1=0 l1=1 r1=1 k1=1 d1=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(boxes=_KEY + f'{_OTHER}<div data-sdui-component="x.aboutTheJob">{_BOX}{_FULL}</div></div>'), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d2", "j1=0 l1=1 r1=1 k1=1 d1=0 d2=1 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step(boxes=_KEY + f"{_BOX}short</div>{_BOX}{_FULL}</div>{_BOX}brief</div>"), "t1 Role", "c1 Firm", "p1 Port", "On-site", "d3", "j1=0 l1=1 r1=1 k1=1 d1=0 d2=0 d3=3 t1=1 c1=1 c2=1 p1=1 w1=1"),
    (_step("<title>Lead {n} | Firm {n} | Site</title>" + _LISTING.replace("Listed", "Lead").replace("https://x/{id}", "none"), firm="", early="", place="", pill="Remote work"), "t2 Lead", "c2 Firm", "p4 Bay", "unknown", "d1", "j1=1 l1=1 r1=1 k1=1 d1=1 t1=0 c1=0 c2=1 p1=0 p4=1 w1=0"),
    (_step("<title>Role {n} | Site</title>" + _LISTING, firm=" "), "t1 Role", "c5 House", "p1 Port", "On-site", "d1", "j1=1 l1=1 r1=1 k1=1 d1=1 t1=1 c1=0 c2=0 c5=1 p1=1 w1=1"),
    (_step(_LISTING, role="Listed {n}", firm=""), "t6 Listed", "c5 House", "p1 Port", "On-site", "d1", "j1=1 l1=1 r1=1 k1=1 d1=1 t2=0 t6=1 c1=0 c2=0 c5=1 p1=1 w1=1"),
    (_step("<title>Role {n}</title>", firm="", place="", pill=""), "t1 Role", None, None, "unknown", "d1", "j1=0 l1=1 r1=1 k1=1 d1=1 t1=1 c1=0 c2=0 p1=0 w1=0"),
    (_old_step(_LINK + '<div class="job-details-jobs-unified-top-card__company-name"><a>Firm {n}</a> and more</div>' + _PRIMARY + _TERTIARY.replace("{place}", "Bay") + _FIT.replace("{first}", "Full-time")), "t3 Role", "c3 Firm", "p2 Port", "Hybrid", "d4", "j1=0 l1=0 l2=0 l3=0 l4=1 r4=0 r5=0 k2=1 d4=1 t3=1 c3=1 p2=1 w2=2"),
    (_old_step('<div class="jobs-search__job-details"><h1>Other</h1><h1 class="x t-24">Role {n}</h1><div class="job-details-jobs-unified-top-card__company-name">Firm {n}<a> </a></div>' + _TERTIARY.replace("{place}", "Port") + _APPLY + "</div>", f'<div class="jobs-description__content"><div class="jobs-box__html-content">{_FULL}</div></div>{_MARK}'), "t4 Role", "c4 Firm", "p3 Port", "unknown", "d5", "j1=0 l1=0 l2=0 l3=0 l4=1 r4=1 k2=0 k3=1 d4=0 d5=1 t3=0 t4=1 c3=0 c4=1 p2=0 p3=1 w2=0"),
    (_old_step('<div class="scaffold-layout__detail"><h1>Role {n}</h1>' + _APPLY + _LISTING + "</div>" + _FIT.replace("{first}", "Remotely").replace("Is Hybrid, or so", "Hybrids"), f'<div class="jobs-box__html-content">{_FULL}</div>{_MARK}'), "t5 Role", "c5 House", "p4 Bay", "unknown", "d6", "j1=1 l1=0 l2=0 l3=0 l4=1 r4=0 r5=1 k2=0 k3=1 d4=0 d5=0 d6=1 t3=0 t4=0 t5=1 c3=0 c4=0 c5=1 p2=0 p3=0 p4=1 w2=2"),
    (_old_step(_APPLY + _LISTING, f'<div class="jobs-description-content__text--stretch"><h3>ABOUT the job</h3>{_FULL}</div>{_MARK}'), "t6 Listed", "c5 House", "p4 Bay", "unknown", "d7", "j1=1 l1=0 l2=0 l3=0 l4=1 r4=0 r5=0 k2=0 k3=1 d4=0 d5=0 d6=0 d7=1 t3=0 t4=0 t5=0 t6=1 c3=0 c4=0 c5=1 p2=0 p3=0 p4=1 w2=0"),
    (_old_step("<h1>Role {n}</h1>" + _APPLY), "t5 Role", None, None, "unknown", "d4", "j1=0 l1=0 l2=0 l3=0 l4=0 l5=1 r4=0 r5=0 k2=0 k3=1 d4=1 t3=0 t4=0 t5=1 c3=0 c4=0 p2=0 p3=0 w2=0"),
)
_AT = f"page_id % {len(STEP_CASES)}"


def _step_case(i: int, after: str = "") -> str:
    return f"CASE {_AT} " + " ".join(f"WHEN {k} THEN {'NULL' if c[i] is None else repr(c[i]) + after}" for k, c in enumerate(STEP_CASES)) + " END"


_NUMBER = " || ' ' || page_id % 17"


@query(f"""SELECT page_id, NULL::VARCHAR AS failure, CASE WHEN {_AT} < 12 THEN 'sdui' ELSE 'classic' END AS layout, {_step_case(1, _NUMBER)} AS title, {_step_case(2, _NUMBER)} AS company, {_step_case(3, _NUMBER)} AS location,
  {_step_case(4)} AS workplace_type, {_step_case(5)} AS description, {_step_case(6)} AS steps, 'paragraph ' || repeat('word ', 60 + page_id % 40) || 'end|paragraph second|bullet1 third|bullet2 fourth' AS blocks FROM pages""")
def job_posting_steps(spark, d):
    """Which step each value is of, all that was tried, and the blocks, where one step after another finds nothing."""
    page = F.col("page_id")
    n, id_ = (page % 17).cast("string"), (100000 + page).cast("string")
    words = F.concat(F.repeat(F.lit("word "), (60 + page % 40).cast("int")), F.lit("end"))
    made = F.get(F.array(*(_filled(c[0], n, id_, words) for c in STEP_CASES)), (page % len(STEP_CASES)).cast("int"))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), id_, F.lit("/")).alias("url"), made.alias("html"))
    short = F.create_map(*(x for name, (field, label) in LABELS.items() for x in (F.lit(f"{field} {label}"), F.lit(name))))

    def named(field: Column, label: Column) -> Column:
        return F.coalesce(F.try_element_at(short, F.concat(field, F.lit(" "), F.replace(label, id_, F.lit("{id}")))), label)

    value = lambda c: F.concat(named(F.lit(c), F.col(f"{c}.selector")), F.lit(" "), F.col(f"{c}.value")).alias(c)
    steps = F.transform("health", lambda h: F.concat(named(h["field"], h["selector"]), F.lit("="), h["matched"].cast("string")))
    blocks = F.transform("description.blocks", lambda b: F.concat(b["kind"], F.coalesce(b["depth"].cast("string"), F.lit("")), F.lit(" "), b["text"]))
    return extract(pages).select(
        "page_id", "failure", "layout", value("title"), value("company"), value("location"), "workplace_type",
        named(F.lit("description"), F.col("description.selector")).alias("description"), F.array_join(steps, " ").alias("steps"), F.array_join(blocks, "|").alias("blocks"),
    )
