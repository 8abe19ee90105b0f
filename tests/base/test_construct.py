"""Trees of any markup: what they are made of, what is kept, and in what time."""

import random
import time

import pytest

from pagewright.operators import construct

TAGS = ("a", "b", "i", "font", "p", "div", "span", "ul", "li", "table", "tr", "td", "tbody", "caption", "h1", "h2", "br", "img", "button", "select", "option", "script", "dl", "dt", "nobr", "object", "form")


def checked(page, xml=False):
    found = construct.parse(page, xml)
    for k, n in enumerate(found):
        assert n["pre"] == k and k <= n["last"] < len(found)
        assert n["path"] == ([*found[n["parent"]]["path"], n["parent"]] if n["parent"] is not None else [])
        assert n["level"] == len(n["path"]) <= construct.DEEPEST + 40
        assert (n["tag"] is None) == (n["text"] is not None)
        if n["parent"] is not None:
            assert n["last"] <= found[n["parent"]]["last"] and found[n["parent"]]["tag"] is not None
    for k, n in enumerate(found):
        below = [j for j in range(k + 1, len(found)) if k in found[j]["path"]]
        assert below == list(range(k + 1, n["last"] + 1))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_any_markup_makes_a_tree(seed):
    rng = random.Random(seed)
    for _ in range(400):
        parts, texts = [], []
        for k in range(rng.randint(0, 25)):
            r = rng.random()
            if r < 0.35:
                texts.append(f"t{k};")
                parts.append(texts[-1])
            elif r < 0.75:
                tag = rng.choice(TAGS)
                parts.append(f"<{tag}{' x=1' if rng.random() < 0.3 else ''}>" + ("</script>" if tag == "script" else ""))
            else:
                parts.append(f"</{rng.choice(TAGS)}>")
        found = checked("".join(parts))
        kept = [t for n in found if n["text"] is not None for t in n["text"].split(";") if t.strip()]
        assert sorted(kept) == sorted(t[:-1] for t in texts), parts  # text moves, none is lost or doubled


def test_nested_right_stays_as_it_is():
    page = '<div id="1"><p>a <b>b</b></p><table><tbody><tr><td>c</td></tr></tbody></table><ul><li>d</li></ul></div>'
    assert [(n["tag"], n["level"]) for n in checked(page)] == [(n["tag"], n["level"]) for n in checked(page, xml=True)]
    assert [n["tag"] or n["text"] for n in checked("<A><B/>x<![CDATA[<y>]]></A>", xml=True)] == ["A", "B", "x", "<y>"]


@pytest.mark.parametrize(
    "hostile",
    ["<b>" * 20_000 + "<p>x" * 2_000, "<b><i>" * 5_000 + "</b></i>" * 5_000, "".join(f"<b k={i}>" for i in range(5_000)) + "<p></p>x" * 2_000, "<table>" * 20_000 + "x" * 10, "<table><tr>x" * 5_000, "<a><div>" * 5_000 + "</a>" * 5_000, "<ul><li>" * 10_000, "</p>" * 50_000],
    ids=range(8),
)
def test_hostile_pages(hostile):
    at = time.process_time()
    found = construct.parse(hostile)
    assert time.process_time() - at < 10 and max(n["level"] for n in found) <= construct.DEEPEST + 40


def test_closed_references():
    page = "<h1>a &amp; b &lt;c&#62; &nosuch; &ampx; &amp</h1>"
    assert [n["text"] for n in construct.parse(page) if n["text"]] == ["a & b <c> &nosuch; &x; &"]
    assert [n["text"] for n in construct.parse(page, closed=True) if n["text"]] == ["a & b <c> &nosuch; &ampx; &amp"]


def test_page_queries_leave_open_references_as_their_sql_does(spark, tmp_path):
    from pagewright.plans import catalogue

    html = "<html><head><title>T &amp</title></head><body><article><h1>T &amp</h1><p>x</p></article></body></html>"
    spark.createDataFrame([(1, "https://a.b/c", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert run("first_match")[0].h1 == run("fallback_pick")[0].value == "T &amp"
    assert not run("cross_check")[0].mismatch and run("blocks_of_pages")[0].text == "T &amp" and run("posting_extract")[0].chars == 7
