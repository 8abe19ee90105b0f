"""Selectors on indexed pages and on columns, against tests of every element and its ancestors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import nodes, rules, selectors

SELECTORS = ("*", "a", "div", "a b", "div div", "div div div", ".x", ".x.y a", "#i", "#i b, div a", "[k]", '[k="v"]', '[k^="v"]', '[k$="w"] a', '[k*="vw"] [k]', "div.x[k] a.y", 'b[k="{p}"]', "a, b, .x", '[k^=""]', "i")


def made(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4)):
        if rng.random() < 0.25:
            out += rng.choice(["t", " ", "u v"])
            continue
        tag = rng.choice(["div", "a", "b", "section"])
        attrs = "".join(x for x in (rng.choice([' class="x"', ' class="y x"', ' class="\tx\ny"']), ' id="i"', rng.choice([' k="v"', ' k="vw"', ' k=""', ' k="p w"'])) if rng.random() < 0.3)
        out += f"<{tag}{attrs}>{made(rng, depth + 1) if depth < 6 else ''}</{tag}>"
    return out


def fits(found, at, chain):
    """Whether the chain's last compound is the element's and the others are ancestors', in any way."""
    n = found[at]
    if n["tag"] is None or not selectors.passes(chain[-1], n["tag"], dict(n["attrs"]), {"p": "v"}):
        return False
    return len(chain) == 1 or any(fits(found, p, chain[:-1]) for p in n["path"])


def test_pages_and_columns_find_what_a_scan_finds(spark):
    rng = random.Random(11)
    pages = ["".join(made(rng) for _ in range(4)) for _ in range(150)]
    want = {}
    for k, page in enumerate(pages):
        found = nodes.parse(page)
        index = rules.Page(found, {"p": "v"})
        for s in SELECTORS:
            hits = [i for i in range(len(found)) if any(fits(found, i, c) for c in selectors.compiled(s))]
            assert index.all(s, -1) == hits, (page, s)
            want[k, s] = hits
            for i in range(0, len(found), 3):
                assert index.covered(i, s) == any(j in hits for j in (*found[i]["path"], i))
                if found[i]["tag"] is not None:
                    assert index.all(s, i) == [j for j in hits if i < j <= found[i]["last"]]
        for i, n in enumerate(found):
            inside = "".join(x["text"] for x in found[i + 1 : n["last"] + 1] if x["tag"] is None)
            assert (index.text(i), index.length(i), index.ink(i)) == (inside, len(inside), len("".join(nodes.normal(inside).split())))
    rows = nodes.trees(spark.createDataFrame(list(enumerate(pages)), "k int, html string").repartition(4))
    n = F.col("nodes")
    every = F.array(*(F.transform(selectors.select_all(s, n, nodes.root_of(n), {"p": F.lit("v")}), lambda x: x["pre"]) for s in SELECTORS))
    for r in rows.select("k", every.alias("found")).collect():
        assert {s: f for s, f in zip(SELECTORS, r.found)} == {s: want[r.k, s] for s in SELECTORS}


@pytest.mark.parametrize("inner", ["<p class='x y'>word {} <span class='t-24'>some · text {}</span></p>", "<p>{}<span data-sdui-component='{}'>"])
def test_large_deep_pages(inner):
    from pagewright.plans.posting import RULES, SDUI_ROOTS

    page = "<title>Engineer | A | S</title>" + '<div data-sdui-screen="x.JobDetails" class="a b">' * 199 + "".join(inner.format(i, i) for i in range(5000))
    at = time.process_time()
    index = rules.Page(nodes.parse(page), {"job_id": "1"} | {r.equals: "Engineer" for r in RULES if r.equals})
    index.root = rules.root_of(index, SDUI_ROOTS, None)
    for rule in RULES:
        rules.apply(rule, index)
    assert time.process_time() - at < 2
