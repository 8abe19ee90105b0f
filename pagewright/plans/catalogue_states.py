"""Queries on what a request may hold and point to: pointers in two passes, names, corrections, states, estimates, lines of items, deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import names, privacy
from pagewright.operators import decide, pointers, requests, spans, usage
from pagewright.plans.catalogue import _ANSWERS_SQL, _RAW_SQL, KINDS, _answers, _raw_lines, _verdicts, query, table
from pagewright.sources import history, scan
from pagewright.sources.shared import shared_dir

# --- pointers: a supplier's items as lines of a CV, every kind of requirement on each

_SECTION_OF = ("summary", "roles[0].lines", "roles[1].lines", "education", "skills", "other", "roles[2].lines")
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
_LINES_SQL = f"""lines AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS line_no, ({list(_SECTION_OF)})[l_linenumber] AS section
  FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_quantity < 15),
pointed AS (SELECT *, regexp_extract(section, '^[a-z]+') AS part FROM lines WHERE section <> 'other'),
items AS (SELECT s_suppkey AS l_suppkey, i AS item, ({list(KINDS)})[i + 1] AS kind FROM supplier, range({len(KINDS)}) AS t(i)),
met AS (SELECT i.*, line_no, section, CASE kind {" ".join(f"WHEN '{k}' THEN part IN {s}" for k, s in pointers.SECTIONS_OF.items())} ELSE true END AS fits FROM items i LEFT JOIN pointed p USING (l_suppkey)),
counted AS (SELECT *, count(line_no) OVER w AS n, count(line_no) FILTER (fits) OVER w AS relevant, count(*) OVER (PARTITION BY l_suppkey, item, section) AS own, min(line_no) OVER (PARTITION BY l_suppkey, item, section) AS first
  FROM met WINDOW w AS (PARTITION BY l_suppkey, item)),
ways AS (SELECT *, CASE WHEN n <= 254 THEN 'all' WHEN relevant <= 254 AND relevant > 0 THEN 'relevant' ELSE 'ranked' END AS way FROM counted),
first_pass AS (SELECT DISTINCT l_suppkey, item, section, first FROM ways WHERE way = 'ranked' AND (fits OR relevant = 0)),
"""
_P_SQL = "CASE WHEN (l_suppkey + item + length(section)) % 4 <> 3 THEN ((l_suppkey * 7 + item * 3 + first * 11) % 100)::DOUBLE / 100 END"


def _pointing(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").where("l_suppkey % 3 <> 0 OR l_quantity < 15")
    no = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER.split(", ")))
    lines = rows.select("l_suppkey", no.alias("line_no"), F.get(F.array(*map(F.lit, _SECTION_OF)), F.col("l_linenumber") - 1).alias("section"))
    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.posexplode(F.array(*map(F.lit, KINDS))).alias("item", "kind"))
    return lines.withColumn("line_id", F.format_string("L%03d", F.col("line_no") - 1)), items


@query(f"""WITH {_LINES_SQL} options AS (SELECT l_suppkey, item, string_agg(section, ',' ORDER BY first) AS options FROM first_pass GROUP BY l_suppkey, item)
SELECT l_suppkey, CAST(item AS INT) AS item, options || ',none' AS options FROM options""")
def pointer_sections(spark, d):
    """The first pass: the sections that are offered where the lines are too many for one question."""
    lines, items = _pointing(spark, d)
    found = pointers.section_questions(pointers.planned(lines, items, "l_suppkey"), "l_suppkey")
    return found.select("l_suppkey", "item", F.array_join("options", ",").alias("options"))


@query(f"""WITH {_LINES_SQL} answers AS (SELECT *, {_P_SQL} AS p FROM first_pass),
numbered AS (SELECT w.l_suppkey, w.item, way, line_no, row_number() OVER (PARTITION BY w.l_suppkey, w.item ORDER BY CASE WHEN way = 'ranked' THEN p END DESC NULLS LAST, w.first, line_no) AS nth
  FROM ways w LEFT JOIN answers a ON a.l_suppkey = w.l_suppkey AND a.item = w.item AND a.section = w.section WHERE line_no IS NOT NULL AND (way = 'all' OR fits OR relevant = 0)),
kept AS (SELECT * FROM numbered WHERE nth <= 254)
SELECT l_suppkey, CAST(item AS INT) AS item, way, nth, printf('L%03d', line_no - 1) AS line_id FROM kept
UNION ALL SELECT l_suppkey, CAST(item AS INT), way, max(nth) + 1, 'none' FROM kept GROUP BY l_suppkey, item, way""")
def pointer_lines(spark, d):
    """Both passes: the lines that a question may point to, 254 at most, by the sections that the first pass's answers put first, and `none`."""
    lines, items = _pointing(spark, d)
    plan = pointers.planned(lines, items, "l_suppkey")
    p = ((F.col("l_suppkey") * 7 + F.col("item") * 3 + F.col("first") * 11) % 100).cast("double") / 100
    ranked = plan.where("way = 'ranked'").select("l_suppkey", "item", "section", p.alias("p")).where((F.col("l_suppkey") + F.col("item") + F.char_length("section")) % 4 != 3)
    return pointers.line_options(lines, plan, ranked, "l_suppkey")


# --- names: customers' names planted in documents' lines

_PLANTED_SQL = f"""customers AS (SELECT count(*) AS n FROM customer), lines AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 3 = 0 THEN text || printf(' by Customer#%09d.', (doc_id * 31 + pos) % n)
  WHEN (doc_id + pos) % 7 = 1 THEN printf('xCustomer#%09d0 ', (doc_id * 17 + pos) % n) || text ELSE text END AS text FROM ({_RAW_SQL}), customers),
known AS (SELECT c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '' UNION ALL SELECT NULL)"""


def _planted(spark, d) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, d, "customer")
    count = customers.agg(F.count("*").alias("n"))
    rows = _raw_lines(spark, d).withColumn("one", F.lit(1)).join(F.broadcast(count.withColumn("one", F.lit(1))), "one")
    name = lambda k, form: F.format_string(form, (F.col("doc_id") * k + F.col("pos")) % F.col("n"))
    at = F.col("doc_id") + F.col("pos")
    text = F.when(at % 3 == 0, F.concat("text", name(31, " by Customer#%09d."))).when(at % 7 == 1, F.concat(name(17, "xCustomer#%09d0 "), "text")).otherwise(F.col("text"))
    known = customers.where("c_custkey % 2 = 0").select(F.col("c_name").alias("string"))
    return rows.select("doc_id", "pos", text.alias("text")), known.unionByName(spark.sql("SELECT '' AS string UNION ALL SELECT NULL"))


@query(f"""WITH {_PLANTED_SQL} SELECT doc_id, pos, replace(text, c_name, '') AS text, CAST(1 AS INT) AS removed FROM lines JOIN known ON c_name <> '' AND contains(text, c_name)""")
def names_removed(spark, d):
    """Lines without the names of half of all customers, wherever in a word they stood."""
    lines, known = _planted(spark, d)
    return names.without(lines, known, ["doc_id", "pos"]).where("removed > 0").select("doc_id", "pos", "text", "removed")


@query(f"WITH {_PLANTED_SQL} SELECT count(*) AS before, CAST(0 AS BIGINT) AS leaks, count(DISTINCT c_name) AS names FROM lines JOIN known ON c_name <> '' AND contains(text, c_name)")
def name_leaks(spark, d):
    """How often confirmed names occur before and, which must be never, after they are removed."""
    lines, known = _planted(spark, d)
    count = lambda rows, *aggs: names.found(rows, known, ["doc_id", "pos"]).agg(*aggs)
    before = count(lines, F.count("*").alias("before"), F.count_distinct("string").alias("names")).withColumn("one", F.lit(1))
    after = count(names.without(lines, known, ["doc_id", "pos"]), F.count("*").alias("leaks")).withColumn("one", F.lit(1))
    return before.join(F.broadcast(after), "one").select("before", "leaks", "names")


# --- corrections: a CV of six lines for each customer, read anew in reverse under a cover line

_OLD = ("Name {k}", "mail a{k}@x.org or b@y.org now", "call {k} soon", "twice", "twice", "skills of {k}")


def _text(template: str) -> Column:
    parts = template.split("{k}")
    return F.concat(*(x for i, p in enumerate(parts) for x in ([F.col("c_custkey").cast("string")] if i else []) + [F.lit(p)]))


def _cv(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines as they were, lines read anew, corrections of the former)"""
    rows = table(spark, d, "customer").select("c_custkey")
    old = rows.select("c_custkey", F.posexplode(F.array(*map(_text, _OLD))).alias("line_no", "text"))
    new = rows.select("c_custkey", F.posexplode(F.array(*map(_text, ("Cover {k}", *reversed(_OLD))))).alias("line_no", "text")).withColumn("section", F.lit("other"))
    n = F.char_length(F.col("c_custkey").cast("string"))

    def note(where: str, line: int, what: str, start: Column | None = None, stop: Column | None = None, section: str | None = None) -> DataFrame:
        at = [F.lit(None).cast("int") if x is None else x.cast("int") for x in (start, stop)]
        return rows.where(where).select("c_custkey", F.lit(line).alias("line_no"), F.lit(what).alias("what"), at[0].alias("start"), at[1].alias("stop"), F.lit(section).cast("string").alias("section"))

    notes = note("true", 2, spans.PRIVATE, F.lit(5), 5 + n).unionByName(note("c_custkey % 2 = 0", 1, spans.PUBLIC, F.lit(5), 12 + n))
    notes = notes.unionByName(note("c_custkey % 4 = 0", 1, spans.PRIVATE, F.lit(0), F.lit(6))).unionByName(note("c_custkey % 3 = 0", 2, spans.HEADER))
    return old, new, notes.unionByName(note("c_custkey % 5 = 0", 4, spans.SECTION, section="skills"))


@query("""WITH each AS (SELECT c_custkey, unnest(range(7)) AS line_no FROM customer)
SELECT c_custkey, CAST(line_no AS INT) AS line_no, CASE WHEN line_no = 3 AND c_custkey % 5 = 0 THEN 'skills' ELSE 'other' END AS section,
  CASE line_no WHEN 0 THEN 'Cover ' || c_custkey WHEN 1 THEN 'skills of ' || c_custkey WHEN 4 THEN 'call  soon' WHEN 6 THEN 'Name ' || c_custkey
    WHEN 5 THEN CASE WHEN c_custkey % 4 = 0 THEN c_custkey || '@x.org or  now' WHEN c_custkey % 2 = 0 THEN 'mail a' || c_custkey || '@x.org or  now' ELSE 'mail  or  now' END ELSE 'twice' END AS text,
  c_custkey % 3 = 0 AND line_no < 4 AS header, line_no IN (4, 5) OR (line_no = 3 AND c_custkey % 5 = 0) AS corrected FROM each
WHERE NOT (line_no = 5 AND c_custkey % 2 <> 0) UNION ALL SELECT c_custkey, 5, 'other', 'mail  or  now', false, false FROM customer WHERE c_custkey % 2 <> 0""")
def corrected_lines(spark, d):
    """An owner's private and public spans, the beginning of the body and a section, on lines that have moved since."""
    old, new, notes = _cv(spark, d)
    found = spans.reapplied(new, spans.noted(notes, old, "c_custkey"), "c_custkey", [dict(privacy.SWEPT)["email"]])
    return found.select("c_custkey", "line_no", "section", "text", "header", F.coalesce("corrected", F.lit(False)).alias("corrected"))


# --- lines of PDF items: an order's parts in two columns of two rows, on baselines that waver, under a wide heading

_X = "CASE WHEN l_linenumber % 2 = 1 THEN 350 ELSE 50 END + 60 * (l_linenumber // 2 % 2)"
_Y = "100 + 20 * (l_linenumber // 4) + (l_partkey % 5 - 2) * 0.4"


@query(f"""WITH items AS (SELECT l_orderkey, l_linenumber % 2 AS side, l_linenumber // 4 AS row, {_X} AS x, {_Y} AS y, 'w' || l_partkey AS text FROM lineitem),
sides AS (SELECT l_orderkey, row, CASE WHEN min(side) OVER (PARTITION BY l_orderkey) = 0 THEN side ELSE 0 END AS side, x, y, text FROM items),
lines AS (SELECT l_orderkey, side, row, min(y) AS y, string_agg(text, ' ' ORDER BY x, y, text) AS text FROM sides GROUP BY ALL
  UNION ALL SELECT DISTINCT l_orderkey, 0, -1, 50, 'Order ' || l_orderkey FROM lineitem)
SELECT l_orderkey, CAST(side AS INT) AS "column", CAST(row_number() OVER (PARTITION BY l_orderkey, side ORDER BY row) AS INT) AS line, round(y::DOUBLE, 2) AS y, text FROM lines""")
def pdf_lines(spark, d):
    no = F.col("l_linenumber")
    x = F.when(no % 2 == 1, 350).otherwise(50) + 60 * (F.floor(no / 2) % 2)
    y = 100 + 20 * F.floor(no / 4) + (F.col("l_partkey") % 5 - 2) * 0.4
    item = lambda x, y, width, text: (F.lit(1).alias("page"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(width).alias("width"), text.alias("text"))
    rows = table(spark, d, "lineitem")
    items = rows.select("l_orderkey", *item(x, y, 50.0, F.concat(F.lit("w"), F.col("l_partkey").cast("string"))))
    heads = rows.select("l_orderkey").distinct().select("l_orderkey", *item(F.lit(50), F.lit(50), 600.0, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))))
    found = scan.lines_of_items(items.unionByName(heads), "l_orderkey")
    return found.select("l_orderkey", "column", "line", F.round("y", 2).alias("y"), "text")


# --- estimates

_CALLS_SQL = "calls AS (SELECT event_id, event_type AS route, ts, event_id * 37 % 1000 AS chars, CASE WHEN event_id % 6 <> 0 THEN event_id * 37 % 1000 * (2 + event_id % 3) // 7 END AS tokens FROM events)"


@query(f"""WITH {_CALLS_SQL}, seen AS (SELECT *, coalesce(sum(chars) FILTER (tokens IS NOT NULL) OVER w, 0) AS c, coalesce(sum(tokens) OVER w, 0) AS t FROM calls
  WINDOW w AS (PARTITION BY route ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, route, chars, CAST(ceil(CASE WHEN c > 0 AND t > 0 THEN (chars * t)::DOUBLE / c::DOUBLE ELSE chars / 3.5 END) AS BIGINT) AS estimate, round(t::DOUBLE / nullif(c, 0)::DOUBLE, 9) AS ratio FROM seen""")
def token_estimates(spark, d):
    """Tokens of requests by what their route's requests before have shown; every sixth has failed."""
    id_ = F.col("event_id")
    chars = id_ * 37 % 1000
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("route"), F.col("ts").alias("at"), chars.alias("chars"), F.when(id_ % 6 != 0, F.floor(chars * (2 + id_ % 3) / 7)).alias("tokens"))
    return usage.estimated(calls, "event_id").select("event_id", "route", "chars", "estimate", F.round("ratio", 9).alias("ratio"))


# --- deletion

_GONE = "c_custkey % 37 = 5"


@query(f"""WITH keyed AS (SELECT o_custkey, ('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 32 AS bucket FROM orders),
gone AS (SELECT c_custkey FROM customer WHERE {_GONE}), hit AS (SELECT DISTINCT ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 32 AS bucket FROM gone)
SELECT CAST(bucket AS INT) AS bucket, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM gone)) AS entries, bucket IN (SELECT bucket FROM hit) AS rewritten FROM keyed GROUP BY bucket""")
def history_deletion(spark, d):
    """A history of orders from which some customers are deleted, twice: what is left in each partition, and which ones have new files."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    files = lambda: {(r[0], r[1]) for r in history._stored(spark, path).select("bucket", F.input_file_name()).distinct().collect()}  # noqa: E731  32 partitions of a file each
    history.append(table(spark, d, "orders"), path, ["o_custkey", "o_orderkey"], "o_custkey", 32)
    before = files()
    gone = table(spark, d, "customer").where(_GONE).select(F.col("c_custkey").alias("o_custkey"))
    for _ in range(2):
        history.delete(spark, path, "o_custkey", gone, 32)
    kept = {b for b, _ in before & files()}
    left = history._stored(spark, path).groupBy("bucket").agg(F.count_if("live").alias("entries"))
    return left.withColumn("rewritten", ~F.col("bucket").isin(*kept) if kept else F.lit(True))


# --- requests

_ATOMS_SQL = _ANSWERS_SQL + ", atoms AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE tier END AS tier, CASE WHEN doc_id % 5 <> 0 THEN kind END AS kind FROM answers)"


def _atoms(spark, d) -> DataFrame:
    id_ = F.col("doc_id")
    return _answers(spark, d).select("doc_id", F.when(id_ % 4 == 0, "unknown").otherwise(F.col("tier")).alias("tier"), F.when(id_ % 5 != 0, F.col("kind")).alias("kind"))


@query(_ATOMS_SQL + f""" SELECT doc_id || '_' || question AS question_id, n AS options FROM atoms, (VALUES ('tier', {len(requests.TIERS)}), ('kind', {len(requests.KINDS)}), ('elig', {len(requests.ELIGIBILITY)})) AS t(question, n)
WHERE tier = 'unknown' OR kind IS NULL OR (kind = 'eligibility_or_logistics' AND question = 'elig')""")
def job_question_fanout(spark, d):
    """The first request's questions on items that code couldn't settle, subtypes asked ahead, and on subtypes of those that it did."""
    return requests.job_questions(_atoms(spark, d), "doc_id").select("question_id", F.size("options").alias("options"))


@query(_ATOMS_SQL + f"""SELECT doc_id, CASE WHEN tier <> 'unknown' THEN tier WHEN doc_id % 8 = 0 THEN 'required' ELSE 'unclassified' END AS tier, found AS kind,
  CASE WHEN found = 'eligibility_or_logistics' THEN CASE WHEN doc_id % 3 = 0 THEN 'travel' ELSE 'other' END END AS subtype
FROM (SELECT *, coalesce(kind, CASE WHEN doc_id % 2 = 0 THEN 'eligibility_or_logistics' END) AS found FROM atoms)""")
def classified_items(spark, d):
    """What the first request's answers settle: half of the tiers and kinds that are asked for are too unsure; subtypes count for eligibility alone."""
    id_ = F.col("doc_id")
    sure = lambda when, best, other: F.create_map(F.lit(best), F.when(when, 0.7).otherwise(0.5), F.lit(other), F.when(when, 0.3).otherwise(0.5))
    asked = {"tier": sure(id_ % 8 == 0, "required", "preferred"), "kind": sure(id_ % 2 == 0, "eligibility_or_logistics", "other"), "elig": sure(id_ % 3 == 0, "travel", "salary")}
    atoms = _atoms(spark, d)
    given = F.inline(F.array(*(F.struct(F.lit(q).alias("given"), p.alias("probs")) for q, p in asked.items())))
    answers = requests.job_questions(atoms, "doc_id").select("doc_id", "question", given).where("given = question")
    return requests.classified(atoms, answers, "doc_id").select("doc_id", "tier", "kind", "subtype")


@query(_ATOMS_SQL + """SELECT doc_id % 50 AS req_id, '{' || string_agg('"' || doc_id || '":{' || concat_ws(',', '"tier":"' || tier || '"', '"kind":"' || kind || '"') || '}', ',' ORDER BY doc_id::VARCHAR) || '}' AS state
FROM atoms WHERE tier = 'unknown' OR kind IS NULL GROUP BY doc_id % 50""")
def posting_states(spark, d):
    """The unsettled items of a request as its state."""
    return requests.state(requests.unsettled(_atoms(spark, d)).withColumn("req_id", F.col("doc_id") % 50), "req_id", "doc_id", "tier", "kind")


_STATE_SQL = """'{"job_title":"Job ' || c_nationkey || '","cv":{"summary":["L000 About ' || c_custkey || '"],"roles":[{"header":["L001 Role a"],"lines":["L002 did ' || c_mktsegment || '","L003 more"]},{"header":[],"lines":["L004 then"]}],"education":[],"skills":["L005 Spark"],"other":[]}}'"""


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'header' WHEN c_custkey % 5 = 1 THEN 'personal' WHEN c_custkey % 5 = 2 AND c_custkey % 3 = 0 THEN 'posting' WHEN c_custkey % 5 = 3 AND c_custkey % 4 = 0 THEN 'section' END AS refused,
  CASE WHEN NOT (c_custkey % 5 < 2 OR (c_custkey % 5 = 2 AND c_custkey % 3 = 0) OR (c_custkey % 5 = 3 AND c_custkey % 4 = 0)) THEN {_STATE_SQL} END AS state FROM customer""")
def cv_states(spark, d):
    """The second request's state of each customer; header lines, personal data, text of the posting, and sections that aren't allowed refuse it."""
    rows, key = table(spark, d, "customer"), F.col("c_custkey")
    made = (
        ("summary", F.concat(F.lit("About "), key.cast("string"))), ("roles[0].header", F.lit("Role a")), ("roles[0].lines", F.concat(F.lit("did "), "c_mktsegment")), ("roles[0].lines", F.lit("more")),
        ("roles[1].lines", F.when(key % 5 == 1, "mail x@y.org").otherwise("then")), ("skills", F.when((key % 5 == 2) & (key % 3 == 0), "We want Spark").otherwise("Spark")),
        ("summary", F.when(key % 5 == 0, "Jo Doe")), ("hobbies", F.when((key % 5 == 3) & (key % 4 == 0), "chess")),
    )
    lines = rows.select("c_custkey", "c_mktsegment", F.posexplode(F.array(*(F.struct(F.lit(s).alias("section"), t.alias("text")) for s, t in made))).alias("line_no", "x"))
    lines = lines.select("c_custkey", "line_no", F.format_string("L%03d", "line_no").alias("line_id"), "x.section", "x.text", (F.col("x.text") == "Jo Doe").alias("header"), F.lit(False).alias("private"))
    titles = rows.select("c_custkey", F.concat(F.lit("Job "), F.col("c_nationkey").cast("string")).alias("title"))
    posting = rows.select("c_custkey", F.explode(F.array(F.lit("We want Spark"), F.lit(""), F.lit("Apply now"))).alias("text"))
    return requests.cv_state(lines.where("text IS NOT NULL"), titles, "c_custkey", posting)


# --- verdicts at their own floor, the ledger's filters, results that are stale, questions that are asked again

_FLOORED_SQL = """SELECT doc_id, req_id, tier, kind, doc_id % 13 = 0 AS excluded, CASE WHEN coverage = 'unclear' OR top < 0.60 THEN 'unclear'
  WHEN (coverage IN ('met', 'partial') AND evidenced < 0.30) OR (coverage = 'not_shown' AND evidenced > 0.70) THEN 'unclear'
  WHEN coverage IN ('met', 'not_shown') AND evidenced > 0.30 AND evidenced < 0.70 THEN 'unclear' ELSE coverage END AS verdict,
  CASE WHEN coverage = 'unclear' THEN 'ambiguous CV text' WHEN top < 0.60 THEN 'split judgment' WHEN (coverage IN ('met', 'partial') AND evidenced < 0.30) OR (coverage = 'not_shown' AND evidenced > 0.70)
    OR (coverage IN ('met', 'not_shown') AND evidenced > 0.30 AND evidenced < 0.70) THEN 'checks disagree' END AS reason FROM answers"""


@query(_ANSWERS_SQL + _FLOORED_SQL)
def floored_verdicts(spark, d):
    """Verdicts by the true top probabilities."""
    rows = _answers(spark, d)
    given = decide.choice(F.col("probs")), decide.top_probability(F.col("probs")), F.col("evidenced")
    return rows.select("doc_id", "req_id", "tier", "kind", (F.col("doc_id") % 13 == 0).alias("excluded"), decide.verdict(*given).alias("verdict"), decide.verdict_reason(*given).alias("reason"))


@query(_ANSWERS_SQL + f""", rows AS ({_FLOORED_SQL}), shown AS (SELECT *, CASE WHEN excluded THEN 'Excluded' WHEN kind = 'eligibility_or_logistics' THEN 'Eligibility' ELSE upper(tier[1]) || tier[2:] END AS filter FROM rows)
SELECT filter, count(*) AS items, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT filter, doc_id FROM shown UNION ALL SELECT 'All', doc_id FROM shown) GROUP BY filter""")
def ledger_filters(spark, d):
    rows = _verdicts(spark, d).select("doc_id", "tier", "kind", (F.col("doc_id") % 13 == 0).alias("excluded"))
    each = [requests.shown(rows, f).agg(F.count("*").alias("items"), F.sum("doc_id").alias("ids")).withColumn("filter", F.lit(f)) for f in requests.LEDGER]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.where("items > 0")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey % 7 <> l_suppkey % 7 AS stale FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stale_results(spark, d):
    """Results of another job than the page's: supplier against customer, modulo 7."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("job_id", F.col("l_suppkey") % 7).withColumn("page_job_id", F.col("o_custkey") % 7)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", requests.stale(rows).alias("stale"))


@query("SELECT p_partkey || '_' || question AS question_id FROM part, (SELECT unnest(['coverage', 'evidenced', 'strength', 'where']) AS question) WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def affected_questions(spark, d):
    """The questions on parts that a correction, here a large return, has changed."""
    asked = requests.questions(table(spark, d, "part").select("p_partkey"), "p_partkey")
    changed = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return requests.affected(asked, changed, "p_partkey").select("question_id")
