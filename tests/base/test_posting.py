"""Refusals and fields of job pages, on small pages of our own."""

import json

import pytest

from pagewright.plans.posting import extract

URL = "https://www.linkedin.com/jobs/view/101/"
BODY = "<p>" + "Word " * 60 + "</p><ul><li>" + "item " * 20 + "</li><li>two</li></ul>"


def sdui(key=101, title="Engineer | Acme | Site", company="Acme", body=BODY, box="box", screen=True, about="x.aboutTheJob"):
    where = ' data-sdui-screen="a.SemanticJobDetails"' if screen else ""
    inner = f'<div data-testid="expandable-text-box">{body}</div>' if box else ""
    return (
        f'<html><head><title>(2) {title}</title></head><body><main><div{where}><a href="/company/1">{company}</a><h1>Engineer</h1><p><span>Paris</span> · new</p><span>Remote</span>'
        f'<div data-sdui-component="{about}" componentkey="JobDetails_AboutTheJob_{key}">{inner}</div></div></main></body></html>'
    )


def classic(key=101, body=BODY):
    top = "job-details-jobs-unified-top-card__"
    return (
        f'<div class="{top}job-title x"><h1><a href="/jobs/view/{key}/">Dev</a></h1></div><div class="{top}company-name"><a>Co</a></div>'
        f'<div class="{top}primary-description-container"><span class="tvm__text">Oslo</span></div>'
        f'<div class="job-details-fit-level-preferences"><button><strong>Hybrid work</strong></button></div><div id="job-details"><h2>About the Job</h2>{body}</div>'
    )


def ld(**job):
    return f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting"} | job)}</script>'


CASES = {
    "sdui": (URL, sdui(), None),
    "sdui by query": ("https://www.linkedin.com/jobs/search/?currentJobId=101", sdui(), None),
    "no screen": (URL, sdui(screen=False), None),
    "classic": (URL, classic(), None),
    "description removed": (URL, sdui(box=""), "no_description"),
    "classic description removed": (URL, classic().replace('id="job-details"', 'id="other"'), "no_description"),
    "other id in the URL": (URL.replace("101", "102"), sdui(), "stale_pane"),
    "classic stale": (URL, classic(102), "stale_pane"),
    "no pane key": (URL, sdui().replace("AboutTheJob_101", "Other_101"), "stale_pane"),
    "no markers": (URL, "<h1>Engineer</h1>", "unknown_layout"),
    "short": (URL, sdui(body="One sentence."), "description_too_short"),
    "wrong host": ("https://example.com/jobs/view/101/", sdui(), "not_linkedin_job"),
    "wrong path": ("https://www.linkedin.com/jobsearch/view/101", sdui(), "not_linkedin_job"),
    "bad URL": ("::", sdui(), "not_linkedin_job"),
    "no URL": (None, None, "not_linkedin_job"),
    "no id": ("https://www.linkedin.com/jobs/collections/", sdui(), "no_job_id"),
    "company differs": (URL, sdui(company="Other"), "company_mismatch"),
    "low pair": (URL, sdui(key=101, title="Elsewhere | Acme | Site", about="x.other").replace('<div data-testid', '<i></i></div><div data-testid'), "low_confidence_fields"),
    "ld only": (URL, ld(title="T", identifier={"value": "101"}), "no_description"),
    "ld of another job": (URL, ld(title="T", identifier="999"), "unknown_layout"),
    "classic without its link": (URL, classic().replace("h1", "h6"), "stale_pane"),
    "no title": (URL, classic().replace("h1", "h6") + '<button class="jobs-apply-button" data-job-id="101">Apply</button>', "no_title"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(CASES.values())]
    rows += [
        (100, URL, sdui(title=" ", company="").replace("(2)", "").replace("<h1>", ld(title="Ld", url=f"{URL}", hiringOrganization={"name": "LdCo"}, jobLocation=[7, {"address": {"addressLocality": "Rome", "addressCountry": "IT"}}]) + "<h1>").replace("·", "-")),
        (101, URL, '<script type="application/ld+json">{bad</script>' + ld(title="Skip", identifier="5") + f'<script type="application/ld+json">{json.dumps({"@graph": [{"@type": ["X", "JobPosting"], "title": "In graph", "identifier": ["101"]}], "@type": "JobPosting", "title": "Outer", "identifier": "101"})}</script>'),
    ]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {(list(CASES)[r.page_id] if r.page_id < 100 else r.page_id): r for r in out}


@pytest.mark.parametrize("name", CASES)
def test_failure(found, name):
    r = found[name]
    assert (r.failure, r.ok) == (CASES[name][2], CASES[name][2] is None)


def test_fields(found):
    r = found["sdui"]
    assert (r.title.value, r.title.confidence, r.company.value, r.location.value, r.location.confidence, r.workplace_type, r.pane_job_id) == ("Engineer", "high", "Acme", "Paris", "medium", "Remote", "101")
    assert [h.field for h in r.health] == ["jsonld", "layout", "detailRoot", "paneJobId", "description", "title", "company", "company", "location", "workplaceType"]
    c = found["classic"]
    assert (c.layout, c.title.value, c.company.value, c.location.value, c.workplace_type) == ("classic", "Dev", "Co", "Oslo", "Hybrid")
    assert c.description.blocks[0].kind == "paragraph" and c.description.selector == "#job-details"
    common = [h for h in found["no screen"].health if h.field == "detailRoot"][-1]
    assert common.selector.startswith("nearest common ancestor") and common.matched == 1
    assert found["sdui by query"].url.source == "currentJobId" and found["sdui"].url.source == "path"


def test_what_comes_after_a_failure_is_null(found):
    assert found["other id in the URL"].title is None and found["other id in the URL"].pane_job_id == "101"
    assert found["company differs"].company.value == "Other"
    assert found["no id"].health == [] and found["ld only"].layout == "jsonld"


def test_json_ld_fills_in(found):
    r = found[100]
    assert (r.title.value, r.title.confidence, r.company.value, r.location.value) == ("Ld", "low", "LdCo", "Rome, IT")
    assert found[101].layout == "jsonld"


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
