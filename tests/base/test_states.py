"""Pointers, names, spans, states, estimates and histories, on small and random cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import names, privacy
from pagewright.operators import pointers, requests, spans, usage
from pagewright.sources import history, scan
from pagewright.streaming import usage as streamed


# --- names


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keyed", [False, True])
def test_names_are_found_wherever_they_stand(spark, seed, keyed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abé ") for _ in range(rng.randint(lo, hi)))
    lines = [(i, i % 3, rng.choice([None, "", word(0, 5)]) if rng.random() < 0.1 else word(5, 40)) for i in range(300)]
    known = [(rng.randint(0, 2), word(1, 7)) for _ in range(60)] + [(0, None), (1, ""), (0, "zzzz"), (2, "a")]
    rows = spark.createDataFrame(lines, "id int, cv int, text string").repartition(4)
    strings = spark.createDataFrame(known, "cv int, string string")
    key = "cv" if keyed else None
    want = {(i, s) for i, cv, t in lines for k, s in known if t and s and s in t and (not keyed or k == cv)}
    assert {tuple(r) for r in names.found(rows, strings, ["id"], key).collect()} == want
    for r in names.without(rows, strings, ["id"], key).collect():
        own = {s for i, s in want if i == r.id}
        text = lines[r.id][2]
        for s in sorted(own, key=lambda s: (-len(s), s)):
            text = text.replace(s, "")
        assert (r.text, r.removed) == (text, len(own))


def test_names_move_texts_once(spark, monkeypatch):
    """Where the index is too large to broadcast, what is shuffled grows with the texts, not with texts times their places."""
    rng = random.Random(3)
    lines = [(i, "".join(chr(rng.randint(97, 122)) for _ in range(3000)) + f" Customer#{i:09d}.") for i in range(100)]
    rows = spark.createDataFrame(lines, "id int, text string").repartition(4)
    strings = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(0, 400, 2)], "string string")
    monkeypatch.setattr(names, "BROADCAST_ROWS", 100)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert {tuple(r) for r in names.found(rows, strings, ["id"]).collect()} == {(i, f"Customer#{i:09d}") for i in range(0, 100, 2)}
    assert written() - before < 4 * sum(len(t) for _, t in lines)


def test_names_keep_ids_with_nulls(spark):
    rows = spark.createDataFrame([(None, 1, "ab 😀cd"), (1, None, "xcd")], "a int, b int, text string")
    got = names.without(rows, spark.createDataFrame([("😀c",), ("cd",)], "string string"), ["a", "b"]).collect()
    assert {(r.a, r.b, r.text, r.removed) for r in got} == {(None, 1, "ab 😀", 2), (1, None, "x", 1)}


def test_names_without_any(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b")], "id int, text string")
    none = spark.createDataFrame([(None,), ("",)], "string string")
    assert names.found(rows, none, ["id"]).count() == 0 and names.without(rows, none, ["id"]).first().text == "a b"
    monkeypatch.setattr(names, "BROADCAST_ROWS", 0)  # beyond the broadcast
    assert names.without(rows, spark.createDataFrame([("a ",)], "string string"), ["id"]).first().text == "b"


# --- spans


def test_spans_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1@.x é") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "a@x.org", "1a@x.orgb@y.deé"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for pattern in (r"a+", r"[0-9]{1,2} ?[a-z]", r"(?<=b)x|é\b", privacy.SWEPT[0][1]):
        for r in rows.select("k", spans.matched(F.col("text"), pattern).alias("s")).collect():
            assert [tuple(s) for s in r.s] == [m.span() for m in re.finditer(pattern, texts[r.k])], (pattern, texts[r.k])
    assert rows.select(spans.matched(F.lit(None).cast("string"), "a").alias("s")).first().s == []


def test_what_is_private_and_public(spark):
    rng = random.Random(4)
    span = lambda: tuple(sorted((rng.randint(0, 12), rng.randint(0, 12))))
    cases = [(i, "abcdéfghij"[: rng.randint(0, 10)], [span() for _ in range(rng.randint(0, 2))], [span() for _ in range(rng.randint(0, 2))], [span() for _ in range(rng.randint(0, 2))]) for i in range(200)]
    rows = spark.createDataFrame(cases, f"k int, text string, f {spans.SPANS}, a {spans.SPANS}, b {spans.SPANS}")
    inside = lambda spans_, i: any(s <= i < e for s, e in spans_)
    for r in rows.select("k", spans.kept_text(*(F.col(c) for c in ("text", "f", "a", "b"))).alias("t")).collect():
        _, text, found, private, public = cases[r.k]
        assert r.t == "".join(c for i, c in enumerate(text) if not (inside(private, i) or (inside(found, i) and not inside(public, i))))


def test_notes_follow_their_lines(spark):
    old = spark.createDataFrame([(1, 0, "x"), (1, 1, "same"), (1, 2, "same"), (1, 3, "gone"), (2, 0, "x")], "cv int, line_no int, text string")
    marks = [(1, 2, spans.SECTION, None, None, "skills"), (1, 2, spans.SECTION, None, None, "other"), (1, 3, spans.PRIVATE, 0, 2, None), (1, 1, spans.HEADER, None, None, None), (2, 0, spans.PRIVATE, 0, 9, None)]
    notes = spans.noted(spark.createDataFrame(marks, "cv int, line_no int, what string, start int, stop int, section string"), old, "cv")
    new = spark.createDataFrame([(1, 0, "s", "new"), (1, 5, "s", "same"), (1, 6, "s", "same"), (1, 7, "s", None), (2, 3, "s", "x"), (3, 0, "s", "same")], "cv int, line_no int, section string, text string")
    out = {(r.cv, r.line_no): (r.section, r.text, r.header) for r in spans.reapplied(new, notes, "cv", ["q"]).collect()}
    assert out == {(1, 0): ("s", "new", True), (1, 5): ("s", "same", False), (1, 6): ("other", "same", False), (1, 7): ("s", None, False), (2, 3): ("s", "", False), (3, 0): ("s", "same", False)}


# --- pointers


def test_pointers(spark):
    lines = [(1, i, f"roles[{i % 2}].lines", f"L{i:03d}") for i in range(9)] + [(1, 9, "skills", "L009"), (1, 10, "hobbies", "L010"), (1, 11, "header", "L011"), (2, 0, "education", "L000")]
    rows = spark.createDataFrame(lines, "cv int, line_no int, section string, line_id string")
    items = spark.createDataFrame([(1, 1, "experience"), (1, 2, "education_or_certification"), (1, 3, "spoken_language"), (1, 4, None), (2, 5, "experience"), (3, 6, "experience")], "cv int, item int, kind string")
    plan = pointers.planned(rows, items, "cv", most=6)
    ways = {r.item: r.way for r in plan.collect()}
    assert ways == {1: "ranked", 2: "relevant", 3: "relevant", 4: "ranked", 5: "all", 6: "all"}
    asked = {r.item: r.options for r in pointers.section_questions(plan, "cv").collect()}
    assert asked == {1: ["roles[0].lines", "roles[1].lines", "none"], 4: ["roles[0].lines", "roles[1].lines", "skills", "none"]}
    ranked = spark.createDataFrame([(1, 1, "roles[1].lines", 0.9), (1, 1, "roles[0].lines", 0.1), (1, 4, "skills", 0.2)], "cv int, item int, section string, p double")
    out = {}
    for r in pointers.line_options(rows, plan, ranked, "cv", most=6).orderBy("item", "nth").collect():
        out.setdefault(r.item, []).append(r.line_id)
    assert out == {
        1: ["L001", "L003", "L005", "L007", "L000", "L002", "none"], 2: ["L009", "none"], 3: ["L009", "none"], 4: ["L009", "L000", "L002", "L004", "L006", "L008", "none"],
        5: ["L000", "none"], 6: ["none"],
    }


# --- lines of items


def test_lines_of_items(spark):
    wavering = [(1, 1, 10.0 * i, 50 + 0.9 * i, 8.0, f"w{i}") for i in range(9)]  # a line that slopes by more than the tolerance in all
    columns = [(2, 1, x, y, 80.0, t) for x, y, t in ((0.0, 10.0, "a"), (200.0, 10.3, "c"), (0.0, 30.0, "b"), (200.0, 29.0, "d"))] + [(2, 1, 0.0, 1.0, 290.0, "wide"), (2, 1, 5.0, 60.0, None, " "), (2, 1, 5.0, 70.0, 4.0, None), (2, 2, 0.0, 1.0, 5.0, "next")]
    rows = spark.createDataFrame(wavering + columns, "cv int, page int, x double, y double, width double, text string")
    out = [(r.cv, r.page, r.column, r.line, r.text) for r in scan.lines_of_items(rows, "cv").orderBy("cv", "page", "column", "line").collect()]
    assert out == [(1, 1, 0, 1, " ".join(f"w{i}" for i in range(9))), (2, 1, 0, 1, "wide"), (2, 1, 0, 2, "a"), (2, 1, 0, 3, "b"), (2, 1, 1, 1, "c"), (2, 1, 1, 2, "d"), (2, 2, 0, 1, "next")]
    assert [r.text for r in scan.lines_of_items(rows.where("cv = 2").drop("width"), "cv").where("page = 1").orderBy("line").collect()] == ["wide", "a c", "b d"]
    assert scan.lines_of_items(rows.limit(0), "cv").count() == 0


# --- estimates


def calls(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), i // 3 * 700, rng.choice([None, 0, rng.randint(1, 500)]), None if rng.random() < 0.3 else rng.randint(0, 90)) for i in range(n)]


def told(rows):
    sums, out = {}, {}
    for i, route, _, chars, tokens in rows:
        c, t = sums.get(route, (0, 0))
        out[i] = None if chars is None else -(-chars * t // c) if c > 0 and t > 0 else -(-chars * 2 // 7)
        if chars is not None and tokens is not None:
            sums[route] = c + chars, t + tokens
    return out


def test_estimates_in_batch_and_stream(spark, tmp_path):
    rows = calls(120, 5)
    made = spark.createDataFrame(rows, "request long, route string, at long, chars long, tokens long").withColumn("at", F.timestamp_seconds("at"))
    want = told(rows)
    assert {r.request: r.estimate for r in usage.estimated(made, "request").collect()} == want
    for k in range(3):
        made.where(f"request >= {40 * k} AND request < {40 * k + 40}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    running = streamed.estimates(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert {r.request: r.estimate for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


# --- histories


def test_deletion_rewrites_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/history"
    rows = spark.createDataFrame([(i if i else None, f"t{i}", "long text") for i in range(200)], "id int, title string, description string")
    for part in (rows.where("id < 100 OR id IS NULL"), rows.where("id >= 100")):
        history.append(part, path, ["id", "title"], "id", 8)
    files = lambda: {(r[0], r[1]) for r in history._stored(spark, path).select("bucket", F.input_file_name()).distinct().collect()}
    before = files()
    gone = spark.createDataFrame([(7,), (7,), (8,), (999,), (None,)], "id int")
    hit = history.delete(spark, path, "id", gone, 8)
    own = history.entries(spark, path)
    assert own.columns == ["id", "title"] and {r.id for r in own.collect()} == set(range(1, 200)) - {7, 8}
    changed = {b for b, _ in before - files()}
    assert set(hit) == changed and 0 < len(changed) < 8
    assert history.delete(spark, path, "id", gone, 8) == hit and history.entries(spark, path).count() == 197
    assert history.delete(spark, path, "id", gone.limit(0), 8) == []
    whole = history.entries(spark, path).where("id IS NOT NULL").select("id")
    history.delete(spark, path, "id", spark.createDataFrame(whole.collect(), "id int"), 8)
    assert history.entries(spark, path).count() == 0
    history.append(rows, path, ["id", "title"], "id", 8)
    assert history.entries(spark, path).count() == 200
    history.delete_all(spark, path)
    assert history.entries(spark, path).count() == 0


# --- requests


def test_several_edits_of_an_item(spark):
    items = spark.createDataFrame([(1, "required", "a"), (2, "required", "b")], "id int, tier string, text string")
    edits = [(1, "set", "unknown", None, 1), (1, "set", None, "b", 2), (1, "set", "preferred", None, 3), (2, "split", None, "x|y", 1), (2, "split", None, "p|q", 2), (2, "split", None, "p|q", 2)]
    out = requests.edited(items, spark.createDataFrame(edits, "id int, op string, tier string, text string, at int"), "id")
    assert sorted(map(tuple, out.collect())) == [(1, "preferred", 0, "b", "edited by you"), (2, "required", 0, "p", "split by you"), (2, "required", 1, "q", "split by you")]
    rows = spark.createDataFrame([(i, "k", f"t{i}", i) for i in range(4)], "id int, kind string, text string, pos int")
    moves = [(0, "move", 9, None), (0, "move", 5, None), (1, "kind", None, "a"), (1, "kind", None, "b"), (2, "merge", 3, None), (2, "merge", 3, None)]
    out = requests.rearranged(rows, spark.createDataFrame(moves, "id int, op string, target int, kind string"), "id")
    assert sorted(map(tuple, out.collect())) == [(0, "k", "t0", 9, "moved by you"), (1, "b", "t1", 1, "edited by you"), (3, "k", "t3 t2", 3, "merged by you")]


def test_states_are_refused(spark):
    lines = [(1, 0, "L000", "summary", "fine", False, False), (2, 0, "L000", "summary", "me@x.org", False, False), (3, 0, "L000", "summary", "fine", None, True), (4, 0, "L000", None, "fine", None, None), (5, 0, "L000", "roles[11].lines", None, None, None)]
    rows = spark.createDataFrame(lines, "cv int, line_no int, line_id string, section string, text string, header boolean, private boolean")
    titles = spark.createDataFrame([(1, "T"), (2, "T")], "cv int, title string")
    out = {r.cv: (r.refused, r.state) for r in requests.cv_state(rows, titles, "cv").collect()}
    assert {k: v[0] for k, v in out.items()} == {1: None, 2: "personal", 3: "personal", 4: "section", 5: None}
    assert out[1][1] == '{"job_title":"T","cv":{"summary":["L000 fine"],"roles":[],"education":[],"skills":[],"other":[]}}'
    assert out[5][1] == '{"cv":{"summary":[],"roles":[{"header":[],"lines":["L000"]}],"education":[],"skills":[],"other":[]}}'
    assert all(v[1] is None for v in out.values() if v[0])


def test_tasks_of_lines_of_items_keep_their_size(spark, monkeypatch):
    items = spark.range(400).selectExpr("id % 100 AS k", "1 AS page", "double(id) AS x", "1.0D AS y", "10.0D AS width", "string(id) AS text")
    monkeypatch.setattr(scan, "TASK_ITEMS", 20)
    found = scan.lines_of_items(items, "k")
    assert "RepartitionByExpression [k#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "], 20" in plan
    assert found.count() == 400


def test_states_meet_postings_in_one_shuffle(spark):
    sections = ["summary", "roles[0].lines", "roles[0].header", "roles[12", "roles[x].lines", "roles[].lines", "roles[ 3].lines", "roles[-3]", "roles", "skills.more", "skills[2]", "Summary", "rolesX[1]", "rolesx[1]", "", None]
    rows = [(k, j, "L", s, f"t{j}") for k, s in enumerate(sections) for j in (2, 10, 1)] + [(100, 1, None, "skills", "copied"), (101, 1, "L", "skills", None), (None, 1, "L", "skills", "copied"), (102, None, "L", "skills", "copied")]
    lines = spark.createDataFrame(rows, "cv int, line_no int, line_id string, section string, text string").selectExpr("*", "false AS header", "false AS private")
    posting = spark.createDataFrame([(100, "copied"), (100, "copied"), (100, " "), (101, None), (0, "t99"), (None, "copied"), (102, "Copied"), (500, "copied")], "cv int, text string")
    titles = spark.createDataFrame([(k, "T") for k in range(3)], "cv int, title string")
    found = requests.cv_state(lines, titles, "cv", posting)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    out = {r.cv: (r.refused, r.state) for r in found.collect()}
    assert found.count() == len(out) == len(sections) + 4
    assert {k for k, v in out.items() if v[0] == "posting"} == {100} and {sections[k] for k, v in out.items() if v[0] == "section"} == {"Summary", "rolesx[1]", "", None}
    many = '["L t1","L t2","L t10"]'
    shown = lambda k: (out[k][1] or "").split('"cv":')[-1]
    empty = {"summary": "[]", "roles": "[]", "education": "[]", "skills": "[]", "other": "[]"}
    cv = lambda **own: "{" + ",".join(f'"{n}":{t}' for n, t in (empty | own).items()) + "}}"
    assert shown(0) == cv(summary=many) and shown(9) == shown(10) == cv(skills=many)
    assert shown(2) == cv(roles='[{"header":' + many + ',"lines":[]}]')
    for k in (1, 3, 4, 5, 6, 7, 8, 12):
        assert shown(k) == cv(roles='[{"header":[],"lines":' + many + "}]"), sections[k]
