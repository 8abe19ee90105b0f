"""Nodes of script source: what is found in code of many forms, and that any text can be read."""

import random
import time

import pytest

from pagewright.sources import scan, script


def kinds(code, name, markup=True):
    return [(line, kind, text) for line, kind, found, text in script.nodes(code, markup) if found == name and kind != "identifier"]


@pytest.mark.parametrize(
    "code,found",
    [
        ("function f({ a: { n } = {}, ...n }) {}", [("binding", "n"), ("binding", "...n")]),
        ("const [n, b] = c", [("binding", "n")]),
        ("const { 'n': d } = e", [("string", "'n'")]),
        ("({ n } = y); x = { n: 1, n }; foo({ n })", []),
        ("const a = 1, { n = 2 } = b; foo, { n }", [("binding", "n = 2")]),
        ("for (const { n } of x) {}", [("binding", "n")]),
        ("try {} catch ({ n }) {}", [("binding", "n")]),
        ("(a, { n }): T => a", [("binding", "n")]),
        ("class A { n() {} m({ n }) { } static async o({ n: p }): Promise<void> { } }", [("binding", "n"), ("binding", "n: p")]),
        ("const {n}: {n: T} = x", [("binding", "n")]),
        ("const f = async ({ n: { x } }) => x", [("binding", "n: { x }")]),
        ("a?.n; b?.[\"n\"]; (c as D).n; e!.n; f[0].n; g``.n", [("member", "a?.n"), ("computed", 'b?.["n"]'), ("string", '"n"'), ("member", "(c as D).n"), ("member", "e!.n"), ("member", "f[0].n"), ("member", "g``.n")]),
        ("return\n['n']", [("string", "'n'")]),
        ("a[`n`]", [("computed", "a[`n`]"), ("string", "`n`")]),
        ("`${a.n} n`.n", [("member", "`${a.n} n`.n"), ("member", "a.n")]),
        ("<A b={c.n} n='n'>n {d.n} it's n</A>; e.n", [("member", "c.n"), ("string", "'n'"), ("member", "d.n"), ("member", "e.n")]),
        ("const f = <T,>(x: T) => x.n", [("member", "x.n")]),
        ("x = '\\x6e' + '\\u{6e}' + '\\\nn'", [("string", "'\\x6e'"), ("string", "'\\u{6e}'"), ("string", "'\\\nn'")]),
        ("this.#n; this.n", [("member", "this.n")]),
        ("a = b /n.n/ c; d = /[/]n.n/g; {} /n.n/", [("member", "n.n")]),
        ("while (a) /'/.exec(b.n)", [("member", "b.n")]),
    ],
)
def test_nodes(code, found):
    assert [(kind, text) for _, kind, text in kinds(code, "n")] == found


def test_lines_are_of_the_beginning():
    assert kinds("x\n\nnew A(1)\n  .b()\n  .n", "n") == [(3, "member", "new A(1)\n  .b()\n  .n")]
    assert kinds("f(`\n\n${a\n.n}`)", "n") == [(3, "member", "a\n.n")]


def test_types_without_markup():
    assert [x[2] for x in kinds("const a = <T>b.n; const c = 'n'", "n", markup=False)] == ["b.n", "'n'"]


def test_any_text_is_read():
    rng = random.Random(5)
    pieces = ["'", '"', "`", "${", "}", "{", "(", ")", "[", "]", "<", ">", "/", "</", "/>", "//", "/*", "*/", "\n", " ", "a", ".", "?.", "=>", "const ", "function ", ":", ",", "...", "\\", "\\u", "=", "!", "#", "9", "é", "\\ud800"]
    for _ in range(4000):
        code = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        for line, _, name, text in script.nodes(code, rng.random() < 0.5):
            assert 1 <= line <= code.count("\n") + 1 and text in code and name.encode() is not None
    for hostile in ("(" * 50_000, "{" * 50_000, "`${" * 30_000, "<a" * 30_000, "<a>" * 30_000, "const {a:" * 20_000, "a." * 50_000, "/*" * 50_000, "'\\" * 50_000):
        at = time.process_time()
        script.nodes(hostile)
        assert time.process_time() - at < 5, hostile[:9]


def test_files_without_code(spark):
    files = spark.createDataFrame([("a.ts", None, 1), (None, "fetch(x)", 2), ("b.js", "", 3)], "path string, code string, line int")
    assert [tuple(r) for r in scan.network_uses(files).collect()] == [(None, 1, "fetch")]
    assert scan.sync_storage_uses(files.limit(0)).count() == 0


def test_both_scans_read_files_once(spark):
    files = spark.createDataFrame([("a.ts", "fetch(a.sync)")], "path string, code string")
    found = scan.uses(files)
    assert {tuple(r) for r in found.collect()} == {("a.ts", "network", 1, "fetch"), ("a.ts", "sync", 1, "a.sync")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_long_chains_cost_no_text_that_is_not_asked_for():
    at = time.process_time()
    assert script.nodes("a." * 200_000, True, ("fetch",)) == [] and time.process_time() - at < 5


def test_a_source_tree_has_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from pagewright.plans import catalogue_sources

    spark.createDataFrame([(i, "Brand#11") for i in range(90)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(catalogue_sources, "FILE_PARTS", 20)
    monkeypatch.setattr(catalogue_sources, "_folder", lambda *_: f"{tmp_path}/source")
    found = catalogue_sources.source_files(spark, str(tmp_path))
    assert len(list((tmp_path / "source").rglob("*.txt"))) == 5
    want = catalogue_sources.code_findings(spark, str(tmp_path)).groupBy("scan", "text").count().collect()
    assert {(r.scan, r.text, r.n) for r in found.collect()} == {tuple(r) for r in want}
