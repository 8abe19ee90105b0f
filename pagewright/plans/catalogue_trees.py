"""Queries on how trees are built and walked: misnested markup, nested lists, strong text, elements that are left out.

Each case is made for rows of pages, `@` standing for the row's number; what is expected was written by the rules of HTML and of
the walker, as markup that is nested right and as blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.operators import nodes, rules, selectors
from pagewright.plans.catalogue import query, table

#: (markup, the tree that HTML makes of it)
MISNESTED = (
    ("<b>1<i>@</b>3</i>4", "<b>1<i>@</i></b><i>3</i>4"),
    ("<b>@<p>2</b>3</p>", "<b>@</b><p><b>2</b>3</p>"),
    ("<a>1<div>2<div>@</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>@</a>4</div>5</div>"),
    ("<a>@<a>y</a>z", "<a>@</a><a>y</a>z"),
    ("<p><b>@<p>y", "<p><b>@</b></p><p><b>y</b></p>"),
    ("<b>1<table><tr><td>2</b>@</table>4", "<b>1<table><tr><td>2@</td></tr></table>4</b>"),
    ("<table>x<tr><td>@</td>y</tr><b>z</table>w", "xy<b>z</b><table><tr><td>@</td></tr></table><b>w</b>"),
    ("<div><table><tr><p>@</p><td>1</table></div>", "<div><p>@</p><table><tr><td>1</td></tr></table></div>"),
    ("<table><tr><td>@<td>b<tr><td>c</table>", "<table><tr><td>@</td><td>b</td></tr><tr><td>c</td></tr></table>"),
    ("<ul><li>@<li>b<ul><li>c</ul>d</ul>", "<ul><li>@</li><li>b<ul><li>c</li></ul>d</li></ul>"),
    ("@</p>y", "@<p></p>y"),
    ("<div><span>@</div>b</span>c", "<div><span>@</span></div>bc"),
    ("<span><div></span>@</div>", "<span><div>@</div></span>"),
    ("<h1>@<h2>b</h3>c", "<h1>@</h1><h2>b</h2>c"),
    ("<table><table><tr><td>@", "<table></table><table><tr><td>@</td></tr></table>"),
    ("<td>@</td>y", "@y"),
    ("<font><p>@</font>b<p>c</p>", "<font></font><p><font>@</font>b</p><p>c</p>"),
    ("<p>1<b>2<i>@<p>4</p>5", "<p>1<b>2<i>@</i></b></p><p><b><i>4</i></b></p><b><i>5</i></b>"),
    ("<div><table><tr><td><div>@</div></div>x</table></div>y", "<div><table><tr><td><div>@</div>x</td></tr></table></div>y"),
    ("<table><caption>@<tr><td><p>x</table>y", "<table><caption>@</caption><tr><td><p>x</p></td></tr></table>y"),
    ("<dl><dt>@<dd>b<p>c<dt>d</dl>", "<dl><dt>@</dt><dd>b<p>c</p></dd><dt>d</dt></dl>"),
)


def _outline(markup: str) -> str:
    """The tags and texts of markup that is nested right, each after its depth; neighbouring texts as one."""
    out, depth = [], 0
    for tag, text in re.findall(r"(</?\w+>)|([^<]+)", markup):
        if tag.startswith("</"):
            depth -= 1
            continue
        out.append(f"{depth}{tag or text}")
        depth += bool(tag)
    return " ".join(out)


def _case_sql(values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"replace(CASE page_id % {len(values)} {whens} END, '@', 'n' || page_id)"


def _made(spark, d, values: list[str]):
    """(page_id, html) with the case of each row."""
    case = F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.replace(case, F.lit("@"), F.concat(F.lit("n"), F.col("page_id").cast("string"))).alias("html"))


def _joined(n: Column) -> Column:
    """The outline of a tree; texts that follow one another at one depth as one."""

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        text = x["tag"].isNull()
        more = text & F.coalesce(last["text"] & (last["level"] == x["level"]), F.lit(False))
        entry = lambda value: F.struct(x["level"].alias("level"), text.alias("text"), value.alias("value"))
        shown = F.when(text, x["text"]).otherwise(F.concat(F.lit("<"), x["tag"], F.lit(">")))
        merged = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(entry(F.concat(last["value"], shown))))
        return F.when(more, merged).otherwise(F.concat(out, F.array(entry(shown))))

    start = F.array().cast("array<struct<level:int,text:boolean,value:string>>")
    return F.array_join(F.transform(F.aggregate(n, start, step), lambda x: F.concat(x["level"].cast("string"), x["value"])), " ")


@query(f"SELECT page_id, {_case_sql([_outline(x) for _, x in MISNESTED])} AS outline FROM pages")
def tree_repairs(spark, d):
    """The trees of misnested markup: formatting that is reopened, content that moves out of tables, ends that are left out or held back."""
    return nodes.trees(_made(spark, d, [x for x, _ in MISNESTED])).select("page_id", _joined(F.col("nodes")).alias("outline"))


#: (markup, its tree as XML, its tree as HTML)
_NESTED = (
    ("<p><span>@<ul><li>one</li></ul></span></p>", "<p><span>@<ul><li>one</li></ul></span></p>", "<p><span>@</span></p><ul><li>one</li></ul><p></p>"),
    ("<A><br>@</br><Td/></A>x", "<A><br>@</br><Td></Td></A>x", "<a><br>@<br></a>x"),
    ("<li>@<li>b</li></li>", "<li>@<li>b</li></li>", "<li>@</li><li>b</li>"),
    ("<s><![CDATA[<i>@]]></s>", "<s>&@</s>", "<s>@]]></s>"),
)


def _both_sql(i: int) -> str:
    outlines = [_outline(c[i].replace("<br>", "<br></br>") if i == 2 else c[i]).replace("1&@", "1<i>@") for c in _NESTED]
    return _case_sql(outlines)


@query(f"SELECT page_id, {_both_sql(1)} AS as_xml, {_both_sql(2)} AS as_html FROM pages")
def trees_of_both_kinds(spark, d):
    """The same markup read as XML, as it is nested, and as HTML."""
    made = _made(spark, d, [c[0] for c in _NESTED])
    shown = lambda xml, name: nodes.trees(made, xml=xml).select("page_id", _joined(F.col("nodes")).alias(name))
    return shown(True, "as_xml").join(shown(False, "as_html"), "page_id")


#: (markup inside the element that is walked, its blocks: kind, text, depth)
WALKED = (
    ("a<script>x</script><style>y</style><noscript>z</noscript><svg><p>s</p></svg> @", (("paragraph", "a @", None),)),
    ("<strong>@</strong> <b>all</b><br>after", (("heading", "@ all", None), ("paragraph", "after", None))),
    ("<strong>@</strong> part<br>named:<br>", (("paragraph", "@ part", None), ("heading", "named:", None))),
    ("<ul><li>one @<ul><li>two<ol><li>three</li></ol></li></ul>rest</li><li>four</li></ul>", (("bullet", "one @", 1), ("bullet", "two", 2), ("bullet", "three", 3), ("bullet", "rest", 1), ("bullet", "four", 1))),
    ("<ul>loose<li>a @</li><div>b</div><h3>c</h3><script>d</script></ul>", (("bullet", "a @", 1), ("paragraph", "b", None), ("paragraph", "c", None), ("paragraph", "d", None))),
    ("<ul><ul><li>@</li></ul></ul>", (("bullet", "@", 1),)),
    ("<strong><ul><li>@</li><li><b>x</b></li></ul>tail</strong>", (("bullet", "@", 1), ("bullet", "x", 1), ("heading", "tail", None))),
    ("<ul><li><p>@</p>b<br>c</li></ul>", (("paragraph", "@", None), ("bullet", "b", 1), ("bullet", "c", 1))),
    ("<div>x</div><div>@</div><h5>y</h5>", (("paragraph", "x@y", None),)),
    ("<h2> <b>@</b>  head </h2><h4><script>s</script></h4>t", (("heading", "@ head", None), ("heading", "s", None), ("paragraph", "t", None))),
    ("<li>@<b> b</b></li><li> </li>", (("bullet", "@ b", 0),)),
    ("<p><strong>@</strong></p><p>b<strong>:</strong></p><!-- c --><em>d</em>", (("heading", "@", None), ("heading", "b:", None), ("paragraph", "d", None))),
)
_VALUES = ", ".join(f"({i}, {p}, '{kind}', '{text}', {'NULL' if depth is None else depth})" for i, (_, blocks) in enumerate(WALKED) for p, (kind, text, depth) in enumerate(blocks))


@query(f"""SELECT page_id, pos, kind, replace(text, '@', 'n' || page_id) AS text, CAST(depth AS INT) AS depth FROM pages JOIN (VALUES {_VALUES}) AS t(k, pos, kind, text, depth) ON page_id % {len(WALKED)} = k""")
def walked_blocks(spark, d):
    """The blocks of nested lists, strong text, elements that are left out, and what isn't told by its tag."""
    made = _made(spark, d, [f'<main><div id="box">{x}</div></main>' for x, _ in WALKED])
    found = rules.read(made, (rules.Rule("box", "#box"),), walks={"box": ("box",)})
    return found.select("page_id", F.posexplode(F.col("walked")["box"]).alias("pos", "b")).select("page_id", "pos", "b.*")


#: A page, and what selectors find in it, in order: ids. `{p}` is a parameter.
_PAGE = '<div id="a" class="x y"><p id="b" k="@v">1<i id="c" class="x">2</i></p><p id="d" class="y" k="@w">3</p></div><section id="e" k="v"><div id="f" class="x"><i id="g" class="z x" k="a@v">4</i></div></section>'
_FOUND = {
    ".x": "acfg", "div i": "cg", "div.x.y p": "bd", '[k^="v"]': "e", '[k$="v"]': "beg", '[k*="w"]': "d", '[k="{p}v"]': "b", "div .x": "cg", "section div.x i[k]": "g",
    "i, p": "bcdg", "#e [k]": "g", "#f, #a .y": "df", "*": "abcdefg", "div div": "", "div p i.x": "c", "[id][class][k]": "dg", '[k="{p}"]': "",
}


@query(" UNION ALL ".join(f"SELECT page_id, '{s}' AS selector, '{ids}' AS found FROM pages" for s, ids in _FOUND.items()))
def selected_elements(spark, d):
    """What selectors find: classes, ids, attributes, descendants and alternatives together."""
    n, params = F.col("nodes"), {"p": F.concat(F.lit("n"), F.col("page_id").cast("string"))}
    ids = lambda s: F.array_join(F.transform(selectors.select_all(s, n, nodes.root_of(n), params), lambda x: nodes.attr(x, "id")), "")
    each = F.array(*(F.struct(F.lit(s).alias("selector"), ids(s).alias("found")) for s in _FOUND))
    return nodes.trees(_made(spark, d, [_PAGE])).select("page_id", F.inline(each))
