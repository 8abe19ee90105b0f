"""Requests, edits and dates on literal rows, and fallbacks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright.operators import fallback, requests, rules
from pagewright.operators.nodes import parse


@pytest.mark.parametrize(
    "text, start, stop, parsed",
    [
        ("Mar 2019 – Present", dt.date(2019, 3, 1), None, True),
        ("January 2019 - February 2020", dt.date(2019, 1, 1), dt.date(2020, 2, 29), True),
        ("2015–2017", dt.date(2015, 1, 1), dt.date(2017, 12, 31), True),
        ("Foo 2019 – Present", None, None, False),
        ("since long ago", None, None, False),
    ],
)
def test_date_range(spark, text, start, stop, parsed):
    r = spark.range(1).select(requests.date_range(F.lit(text)).alias("r")).first().r
    assert (r.start, r.stop, r.parsed) == (start, stop, parsed)


def test_state_and_pointers(spark):
    rows = spark.createDataFrame([(1, "a02", "S1", 'say "hi"'), (1, "a01", "S1", None)], "k int, id string, section string, text string")
    assert requests.state(rows, "k", "id", "section", "text").first().state == '{"a01":{"section":"S1"},"a02":{"section":"S1","text":"say \\"hi\\""}}'
    lines = spark.range(300).selectExpr("1 AS k", "id AS line_no")
    assert {r["pass"] for r in requests.pointer_options(lines, "k", F.col("line_no") < 254).collect()} == {1}
    assert {r["pass"] for r in requests.pointer_options(lines, "k", F.col("line_no") < 255).collect()} == {2}


def test_selection_of_what_is_asked(spark):
    items = spark.createDataFrame([(1, "unknown", "other"), (2, "required", None), (3, "required", "other")], "id int, tier string, kind string")
    assert sorted(r.id for r in requests.unsettled(items).collect()) == [1, 2]
    assert requests.affected(requests.questions(items, "id"), items.where("id = 3"), "id").count() == 4
    shown = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", None)], "job_id string, page_job_id string")
    assert [r[0] for r in shown.select(requests.stale(shown)).collect()] == [False, True, True]


def test_fallbacks(spark):
    a, b = F.lit(None).cast("string"), F.lit("v")
    row = spark.range(1).select(fallback.pick([fallback.field(a, "one", "high"), fallback.field(b, "two", "low")]).alias("f"), fallback.tried("x", [("one", F.lit(0)), ("two", F.lit(3)), ("three", F.lit(1))]).alias("t")).first()
    assert tuple(row.f) == ("v", "two", "low")
    assert [tuple(h) for h in row.t] == [("x", "one", 0), ("x", "two", 3)]


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("p", ["a b", "c"]), ("div p", ["a b"]), (".x", ["a b"]), ("#i", ["c"]), ('[href^="/u"]', ["b"]), ('[href$="/1"]', ["b"]), ('[href*="se"]', ["b"]), ("p a, #i", ["b", "c"]), ("div.y p.x a[href]", ["b"]),
        ('[k="{who}"]', ["c"]), ("section p", []),
    ],
)
def test_selectors(selector, texts):
    nodes = parse('<div class="y z"><p class="w x">a <a href="/user/1">b</a></p></div><p id="i" k="me">c</p>')
    for n in nodes:
        n["map"] = dict(n["attrs"])
    page = rules.Page(nodes, {"who": "me"})
    assert [page.text(i) for i in page.all(selector, -1)] == texts


@pytest.mark.parametrize("selector", ["a::before", "p > a", "[a~=b]"])
def test_selectors_out_of_scope(selector):
    with pytest.raises(ValueError):
        rules.compiled.__wrapped__(selector)
