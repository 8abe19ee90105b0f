"""The text kernel, URLs, privacy, statements, decisions, sources and the stream, on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import atoms, privacy, text, urls
from pagewright.operators import decide, jsonld
from pagewright.sources import scan
from pagewright.streaming import pages as stream


def one(spark, column, *values):
    """column of literal values a, b, ... ."""
    return spark.range(1).select(column(*(F.lit(v) for v in values)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, value, expected",
    [
        (text.normalize_text, "  a\t\v b﻿", "a b"),
        (text.normalize_text, "", ""),
        (text.utf16_length, "a\U0001f600b", 4),
        (text.non_empty, " \n", None),
        (text.decode_entities, "&amp;lt; &copy; &middot;", "&lt; © ·"),
        (text.document_title, "<TITLE> A &amp;\n B </title>", "A & B"),
        (text.document_title, "<p>", ""),
        (text.title_parts, "(3) Dev | Co | Site", ("Dev", "Co")),
        (text.title_parts, "Dev | Site", ("Dev", None)),
        (text.split_sentences, "One. Two! three", ["One.", "Two!", "three"]),
        (urls.guard, "https://www.linkedin.com/jobs", True),
        (urls.guard, "https://WWW.LinkedIn.com:99/jobs/x", True),
        (urls.guard, "https://www.linkedin.com/jobsx", False),
        (urls.guard, "::", False),
        (urls.guard, None, False),
        (urls.identity, "https://h/jobs/view/12ab?currentJobId=%31%32", ("12", "currentJobId")),
        (urls.identity, "https://h/jobs/view/12ab?currentJobId=9x", ("12", "path")),
        (urls.identity, "https://h/jobs/view/slug-1", ("", "path")),
        (privacy.sweep, "write a.b@c.de or +49 (30) 1234567, at 12 Long Street now", "write or , at now"),
        (privacy.sweep, "x@y.de", None),
        (privacy.protected, "Date of Birth: 1990", True),
        (privacy.protected, "managed pages", False),
    ],
)
def test_text(spark, f, value, expected):
    found = one(spark, f, value)
    assert (tuple(found) if isinstance(expected, tuple) else found) == expected


@pytest.mark.parametrize(
    "coverage, top, evidenced, expected",
    [
        ("unclear", 0.9, 0.9, "unclear"), ("met", 0.59, 0.9, "unclear"), ("met", 0.60, 0.71, "met"), ("met", 0.9, 0.29, "unclear"), ("met", 0.9, 0.30, "met"), ("met", 0.9, 0.31, "unclear"),
        ("met", 0.9, 0.70, "met"), ("partial", 0.9, 0.5, "partial"), ("partial", 0.9, 0.2, "unclear"), ("not_shown", 0.9, 0.71, "unclear"), ("not_shown", 0.9, 0.1, "not_shown"),
    ],
)
def test_verdict(spark, coverage, top, evidenced, expected):
    assert one(spark, decide.verdict, coverage, top, evidenced) == expected


def test_statements(spark):
    rows = [(1, i, k, t) for i, (k, t) in enumerate([("paragraph", "Above."), ("heading", "What you’ll bring:"), ("bullet", "5+ years of Python"), ("paragraph", "loose"), ("heading", "Bonus"), ("paragraph", "Go is nice. A visa is required."), ("heading", "Else"), ("bullet", "No age limit, a degree")])]
    out = atoms.numbered(atoms.classify(atoms.split_atoms(atoms.sections(spark.createDataFrame(rows, "id long, pos int, kind string, text string"), "id"), "id")), "id").orderBy("atom_no").collect()
    assert [(r.atom_id, r.text, r.tier, r.tier_source, r.route, r.min_years) for r in out] == [
        ("a01", "Above.", "unknown", None, "assessed", None),
        ("a02", "5+ years of Python", "required", "heading", "assessed", 5),
        ("a03", "Go is nice.", "preferred", "heading", "assessed", None),
        ("a04", "A visa is required.", "required", "cue", "eligibility", None),
        ("a05", "No age limit, a degree", "unknown", None, "excluded", None),
    ]
    assert out[1].phrase == "Python" and out[4].degree and all(r.active and not r.warned for r in out)


@pytest.mark.parametrize("tier, headings", atoms.HEADINGS.items())
def test_every_heading(spark, tier, headings):
    df = spark.createDataFrame([(h.upper() + ":", "x") for h in headings], "heading string, text string")
    assert {r.tier for r in atoms.classify(df).collect()} == {tier}


def test_decisions(spark):
    assert one(spark, lambda *v: decide.batches(F.array(*v), 26), 10, 10, 10, 25, 5) == [0, 0, 1, 2, 3]
    days = [(1, dt.date(2020, 1, 1), dt.date(2020, 2, 1)), (1, dt.date(2020, 2, 1), dt.date(2020, 3, 1)), (1, dt.date(2021, 1, 1), dt.date(2021, 1, 5)), (1, dt.date(2020, 1, 5), dt.date(2020, 1, 6)), (2, None, dt.date(2020, 1, 1))]
    merged = decide.merged_intervals(spark.createDataFrame(days, "k int, a date, b date"), "k", "a", "b").orderBy("a").collect()
    assert [(r.a, r.b) for r in merged] == [(dt.date(2020, 1, 1), dt.date(2020, 3, 1)), (dt.date(2021, 1, 1), dt.date(2021, 1, 5))]
    answers = spark.createDataFrame([(1, {"L001": 0.5, "L002": 0.15, "L003": 0.14}), (2, {"none": 0.6, "L001": 0.4})], "k int, p map<string,double>")
    assert [(r.k, r.line_id) for r in decide.evidence(answers, "k", "p").orderBy("nth").collect()] == [(1, "L001"), (1, "L002")]
    cover = decide.coverage(spark.createDataFrame([(1, v) for v in ("met", "partial", "unclear", "not_shown")] + [(2, "unclear")], "k int, verdict string"), ["k"]).orderBy("k").collect()
    assert [(r.low, r.high) for r in cover] == [(0.375, 0.625), (0.0, 1.0)]
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "r int, q string")
    done = decide.complete(asked, asked.where("NOT (r = 1 AND q = 'b')"), "r", "q").orderBy("r").collect()
    assert [(r.missing, r.ok) for r in done] == [(1, False), (0, True)]
    for args, expected in (((5.0, 3, True, False), "met"), ((1.0, 3, True, False), "partial"), ((0.0, 3, True, False), "not_shown"), ((5.0, 3, False, False), "unclear"), ((5.0, 3, True, True), "unclear")):
        assert one(spark, decide.years_verdict, *args) == expected


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("const a = fetch('u')\nstore.sync.get()\nprefetch(1)\n")
    (tmp_path / "y.md").write_text("fetch")
    files = scan.source_tree(spark, str(tmp_path))
    assert [r.line for r in scan.network_uses(files).collect()] == [1] and [r.line for r in scan.sync_storage_uses(files).collect()] == [2]
    assert scan.violations(scan.network_uses(files)).first().violation.endswith("x.ts:1 fetch")
    items = spark.createDataFrame([(1, 1, 5.0, 1.0, "b"), (1, 1, 1.0, 1.0, "a"), (1, 2, 1.0, 1.0, None)], "cv int, page int, x double, y double, text string")
    assert {r.text for r in scan.lines_of_items(items.where("text IS NOT NULL"), "cv").collect()} == {"a b"}
    assert scan.readable(items, "cv").first().readable is False
    packages = spark.createDataFrame([({"p": (False, "GPL"), "q": (True, "GPL"), "r": (False, "MIT")},)], "packages map<string,struct<dev:boolean,license:string>>")
    assert [r.name for r in scan.license_problems(packages, ["MIT"]).collect()] == ["p"]
    for pattern, ok in (("https://a.com/*", True), ("https://*.a.com/*", False), ("*://*/*", False), ("https://b.com/*", False)):
        assert one(spark, lambda p: scan.host_allowed(p, ["a.com"]), pattern) is ok
    for pattern, ok in (("https://www.shop.com/*", True), ("*://*.shop.org/*", True), ("<all_urls>", True), ("*://*/*", True), ("storage", False), ("https://a.com/shop", False), (None, False)):
        assert one(spark, lambda p: scan.grants_access(p.cast("string"), ["shop", "mall"]), pattern) is ok


def test_histories(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a", "long text"), (2, "b", "long text"), (2, "c", None)], "id int, verdict string, description string")
    for part in (entries.where("id = 1"), entries.where("id = 2")):
        scan.append_history(part, f"{tmp_path}/history", ["id", "verdict"])
    scan.delete_history(spark, f"{tmp_path}/history", f"{tmp_path}/less", "id", spark.createDataFrame([(2,), (2,), (9,)], "id int"))
    less = spark.read.parquet(f"{tmp_path}/less")
    assert less.columns == ["id", "verdict"] and [tuple(r) for r in less.collect()] == [(1, "a")]
    scan.delete_history(spark, f"{tmp_path}/history", f"{tmp_path}/none", "id")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0 and spark.read.parquet(f"{tmp_path}/history").count() == 3


def test_session_store(spark):
    rows = spark.createDataFrame([(1, "a", "long", "<p>")], "id int, verdict string, description string, html string")
    kept = scan.session_store(rows, "held")
    assert spark.table("held").columns == ["id", "verdict"] and spark.table("held").count() == 1
    spark.catalog.dropTempView("held")
    kept.unpersist()


def test_pasted_text(spark):
    lines = spark.createDataFrame([(1, 1, 1.0, "scanned"), (2, 1, 1.0, "kept")], "cv int, page int, y double, text string")
    typed = spark.createDataFrame([(1, "one\n \ntwo"), (3, ""), (4, None)], "cv int, text string")
    assert sorted((r.cv, r.text) for r in scan.pasted(lines, typed, "cv").collect()) == [(1, "one"), (1, "two"), (2, "kept")]


def test_files_and_notices(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\n</p>")
    (tmp_path / "b.json").write_text('{"n": [1,\n2]}')
    assert [r.html for r in scan.page_files(spark, f"{tmp_path}/*.html").collect()] == ["<p>\n</p>"]
    assert scan.json_file(spark, f"{tmp_path}/b.json").first().n == [1, 2]
    scan.write_results(spark.range(3).selectExpr("id", "id % 2 AS odd"), f"{tmp_path}/out", "odd")
    scan.write_results(spark.range(3, 4).selectExpr("id", "id % 2 AS odd"), f"{tmp_path}/out", "odd")
    assert spark.read.parquet(f"{tmp_path}/out").where("odd = 1").count() == 2
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [r.name for r in scan.unlisted(names("p", "q"), names("q")).collect()] == ["p"]
    runs = spark.createDataFrame([("a", 1, "m1"), ("a", 2, "m1"), ("a", 3, "m2"), ("b", 1, "m2")], "run string, at int, model string")
    assert {(r.run, r.at) for r in scan.latest_model(runs, "run").where("changed").collect()} == {("a", 3)}


def test_postings_at_any_depth(spark):
    inner = '{"@type":"JobPosting","title":"In"}'
    texts = [
        "[" * 400 + inner + "]" * 400,
        '{"@graph":' * 300 + inner + "}" * 300,
        '{"@graph":null,"@type":"JobPosting","title":"Own"}',
        '[{"@type":"JobPosting","title":"Out","@graph":[[' + inner + '],"text",3,null]},' + inner + "]",
        "[]",
        '"JobPosting"',
        "null",
        "no json",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    values = F.filter(F.array(F.try_parse_json("t")), lambda v: v.isNotNull())
    found = rows.select("i", F.transform(jsonld.postings(values), lambda v: jsonld.text_at(v, "$.title")).alias("x")).collect()
    assert {r.i: r.x for r in found} == {0: ["In"], 1: ["In"], 2: ["Own"], 3: ["In", "Out", "In"], 4: [], 5: [], 6: [], 7: []}


def test_postings_below_many_graphs_take_linear_time():
    deep = lambda n: '{"@graph":[' * n + '{"@type":["Thing","JobPosting"],"title":"In","x":1e999}' + "]}" * n
    assert [json.loads(x) for x in jsonld._opened(deep(490))] == [{"@type": ["Thing", "JobPosting"], "title": "In", "x": None}]
    nested = '{"@type":"JobPosting","title":"Out","@graph":[' * 400 + "]}" * 400
    assert sum(map(len, jsonld._opened(nested))) < 2 * len(nested)


def test_stream(spark, tmp_path):
    rows = [(1, "https://www.linkedin.com/jobs/view/7", "<title>A</title>", dt.datetime(2026, 1, 1, 0, 1)), (2, "https://x.y/", None, dt.datetime(2026, 1, 1, 0, 2))]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(f"{tmp_path}/in")
    query = stream.counts(stream.pages(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.ok, r.pages) for r in spark.table("counted").collect()} == {(True, 1), (False, 1)}
    query = stream.write_postings(stream.pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(180)
    assert {(r.page_id, r.failure) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "unknown_layout"), (2, "not_linkedin_job")}


def test_the_rest_works_without_the_corpus_subpackage():
    import subprocess
    import sys

    code = (
        "import sys\nclass Gone:\n def find_spec(self, name, *a):\n  if name.startswith(('pagewright.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'failure_histogram' in e.queries() and not any(k.startswith('op') for k in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_captures_share_files(spark, tmp_path):
    rows = [(1, "<title>\r\n\u2028\u0000\n"), (2, ""), (3, None), (None, "x"), (None, None), (3, None), (4, "\U0001f600\u0085\\\"" + "ab" * 11_000_000)] + [(k, "y") for k in range(5, 60)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    scan.write_captures(pages, str(tmp_path / "pages"))
    assert len(list((tmp_path / "pages").glob("part-*"))) <= 3
    order = lambda r: (r[0] or 0, r[1] or "", r[1] is None)
    assert sorted((tuple(r) for r in scan.captures(spark, str(tmp_path / "pages"), pages.schema).collect()), key=order) == sorted(rows, key=order)


def test_page_captures_make_no_file_for_each_page(spark, tmp_path):
    from pagewright.plans import catalogue_sources

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(k, f"<title>{k}</title>") for k in range(40)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    found = catalogue_sources.page_captures(spark, str(tmp_path / "in"))
    assert found.where("titled AND chars >= 16").count() == 40 and len(found.inputFiles()) == 1
