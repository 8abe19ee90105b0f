"""More registered queries: requests, reviews and edits on tables derived from the standard ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import atoms, privacy, text
from pagewright.operators import decide, requests
from pagewright.plans.catalogue import _ANSWERS_SQL, _RAW_SQL, _SWEEP, _answers, _blocks, _LINES_SQL, _raw_lines, _verdicts, norm_sql, query, table


@query("""WITH expected AS (SELECT DISTINCT l_orderkey AS request, l_linenumber AS question FROM lineitem),
missing AS (SELECT e.request, count(*) AS missing FROM expected e WHERE NOT EXISTS
  (SELECT 1 FROM lineitem a WHERE a.l_orderkey = e.request AND a.l_linenumber = e.question AND a.l_returnflag <> 'R') GROUP BY e.request)
SELECT DISTINCT e.request, coalesce(m.missing, 0) AS missing, coalesce(m.missing, 0) = 0 AS ok FROM expected e LEFT JOIN missing m USING (request)""")
def answer_completeness(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("question"), "l_returnflag")
    return decide.complete(rows.select("request", "question").distinct(), rows.where("l_returnflag <> 'R'").select("request", "question"), "request", "question")


@query(f"""WITH lines AS ({_RAW_SQL}), each AS (SELECT doc_id, pos, length(text) AS n FROM lines)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share,
  sum(n) >= 200 AND avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) <= 0.5 AS readable FROM each GROUP BY doc_id""")
def readable_documents(spark, d):
    """Lines stand for pages."""
    from pagewright.sources.scan import readable

    rows = readable(_raw_lines(spark, d).withColumnRenamed("pos", "page"), "doc_id")
    return rows.withColumn("chars", F.col("chars").cast("long")).withColumn("empty_share", F.round("empty_share", 6))


@query("""SELECT lang, count(*) AS requests, CAST(sum(ceil(n_chars / 3.5)) AS BIGINT) AS tokens, round(sum(ceil(n_chars / 3.5)) * 0.042e-6, 6) AS usd FROM documents GROUP BY lang""")
def request_cost(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("requests"), F.sum(decide.token_estimate(F.col("n_chars"))).alias("tokens"))
    return rows.withColumn("usd", F.round(F.col("tokens") * decide.USD_PER_TOKEN, 6))


@query(f"""WITH lines AS (SELECT doc_id, {norm_sql("text")} AS raw, nullif({norm_sql(_SWEEP)}, '') AS sent FROM ({_RAW_SQL}))
SELECT doc_id, count(*) FILTER (WHERE raw <> '') AS had, count(sent) AS sent_lines, count(*) FILTER (WHERE raw <> '' AND sent IS DISTINCT FROM raw) AS stripped,
  CAST(coalesce(sum(length(sent)), 0) AS BIGINT) AS sent_chars FROM lines GROUP BY doc_id""")
def stripped_summary(spark, d):
    """What is stripped and what would be sent, from the lines themselves."""
    rows = _raw_lines(spark, d).select("doc_id", text.normalize_text(F.col("text")).alias("raw"), privacy.sweep(F.col("text")).alias("sent"))
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("raw") != "").alias("had"),
        F.count("sent").alias("sent_lines"),
        F.count_if((F.col("raw") != "") & ~F.col("sent").eqNullSafe(F.col("raw"))).alias("stripped"),
        F.coalesce(F.sum(F.char_length("sent")), F.lit(0)).alias("sent_chars"),
    )


_MARKED_SQL = f"""SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN text || ' ' || upper(({list(privacy.PROTECTED)})[(doc_id + pos) // 5 % {len(privacy.PROTECTED)} + 1]) || ', as asked'
  WHEN (doc_id + pos) % 5 = 1 THEN 'teenagers manage agendas; ' || text ELSE text END AS text FROM ({_RAW_SQL})"""


@query(f"""SELECT doc_id, pos, text FROM ({_MARKED_SQL}) WHERE regexp_matches(lower(text), '(?:^|[^a-z])(?:{"|".join(privacy.PROTECTED)})(?:[^a-z]|$)')""")
def withheld_lines(spark, d):
    """Lines that name protected attributes, planted in some, among lines that hold their letters only."""
    at = F.col("doc_id") + F.col("pos")
    named = F.element_at(F.array(*map(F.lit, privacy.PROTECTED)), (F.floor(at / 5) % len(privacy.PROTECTED) + 1).cast("int"))
    marked = F.when(at % 5 == 0, F.concat("text", F.lit(" "), F.upper(named), F.lit(", as asked"))).when(at % 5 == 1, F.concat(F.lit("teenagers manage agendas; "), "text")).otherwise(F.col("text"))
    return _raw_lines(spark, d).select("doc_id", "pos", marked.alias("text")).where(privacy.protected(F.col("text")))


@query(_LINES_SQL + """SELECT b.doc_id, b.pos, b.text FROM blocks b JOIN (SELECT doc_id, min(pos) FILTER (WHERE kind = 'heading') AS cut FROM blocks GROUP BY doc_id) h USING (doc_id) WHERE b.pos < h.cut""")
def header_split(spark, d):
    """Lines above the first heading."""
    cut = F.min(F.when(F.col("kind") == "heading", F.col("pos"))).over(Window.partitionBy("doc_id"))
    return _blocks(spark, d).withColumn("cut", cut).where("pos < cut").select("doc_id", "pos", "text")


_RANGES = """SELECT o_orderkey, strftime(o_orderdate, '%b %Y') || ' – ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Present' ELSE strftime(o_orderdate + INTERVAL 200 DAY, '%b %Y') END AS role, o_orderdate FROM orders"""


@query(f"""SELECT o_orderkey, role, CAST(date_trunc('month', o_orderdate) AS DATE) AS start,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(last_day(o_orderdate + INTERVAL 200 DAY) AS DATE) END AS stop, true AS parsed FROM ({_RANGES})""")
def role_dates(spark, d):
    """Ranges written out from order dates, and read back."""
    show = lambda x: F.date_format(x, "MMM yyyy")
    day = F.to_date("o_orderdate")
    role = F.concat(show(day), F.lit(" – "), F.when(F.col("o_orderkey") % 3 == 0, "Present").otherwise(show(F.date_add(day, 200))))
    return table(spark, d, "orders").select("o_orderkey", role.alias("role")).select("o_orderkey", "role", F.inline(F.array(requests.date_range(F.col("role")))))


@query("""SELECT o_custkey, round(sum(days) / 365.25, 4) AS years, CASE WHEN sum(days) / 365.25 >= 2 THEN 'met' WHEN sum(days) > 0 THEN 'partial' ELSE 'not_shown' END AS verdict FROM (
WITH spans AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 90 AS stop FROM orders),
marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT o_custkey, max(stop) - min(start) AS days FROM islands GROUP BY o_custkey, island) GROUP BY o_custkey""")
def years_of_experience(spark, d):
    """Merged role ranges in years, against two."""
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start")).withColumn("stop", F.date_add("start", 90))
    years = decide.merged_intervals(rows, "o_custkey", "start", "stop").groupBy("o_custkey").agg((F.sum(F.datediff("stop", "start")) / 365.25).alias("years"))
    return years.select("o_custkey", F.round("years", 4).alias("years"), decide.years_verdict(F.col("years"), F.lit(2), F.lit(True), F.lit(False)).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment IS NULL THEN 'Needs your call' WHEN n_regionkey = 1 THEN 'Matches' ELSE 'Conflict' END AS result
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def eligibility_compare(spark, d):
    """A customer's region against region 1; a negative balance stands for a value that isn't exact."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    exact = (F.col("c_acctbal") >= 0) & F.col("c_mktsegment").isNotNull()
    return rows.select("c_custkey", requests.compared(F.col("n_regionkey"), F.lit(1), exact).alias("result"))


@query("""SELECT doc_id, question, doc_id || '_' || question AS question_id FROM documents, (SELECT unnest(['coverage', 'evidenced', 'strength', 'where']) AS question) WHERE doc_id % 3 = 0""")
def question_fanout(spark, d):
    """Four questions for each required item."""
    return requests.questions(_answers(spark, d).where("tier = 'required'"), "doc_id").select("doc_id", "question", "question_id")


@query(_ANSWERS_SQL + """SELECT doc_id, CASE WHEN evidenced BETWEEN 0.30 AND 0.70 THEN 'in the band' WHEN top < 0.60 THEN 'split' END AS review FROM answers""")
def review_bands(spark, d):
    return _answers(spark, d).select("doc_id", requests.reviewed(F.col("evidenced"), decide.top_probability(F.col("probs"))).alias("review"))


@query(_ANSWERS_SQL + "SELECT req_id, round(sum((doc_id % 3 + 1) * score / 4) / sum(doc_id % 3 + 1), 6) AS composite FROM answers GROUP BY req_id")
def composite_score(spark, d):
    total, weight = requests.composite(F.col("score"), F.lit(5), F.col("doc_id") % 3 + 1)
    return _answers(spark, d).groupBy("req_id").agg(F.round(F.try_divide(total, weight), 6).alias("composite"))


@query("""SELECT event_id, user_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM events""")
def model_changes(spark, d):
    """Event types stand for the model that answered."""
    from pagewright.sources.scan import latest_model

    runs = table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("model"))
    return latest_model(runs, "user_id").select("event_id", "user_id", "changed")


@query("""SELECT s AS status, count(*) AS calls, any_value(CASE WHEN s BETWEEN 200 AND 299 THEN 'use' WHEN s IN (401, 403) THEN 'key error' WHEN s = 402 THEN 'credit'
  WHEN s IN (408, 429, 500, 502, 503, 504) THEN 'retry' ELSE 'reject' END) AS action FROM (SELECT list_value(200, 204, 400, 401, 402, 403, 404, 408, 422, 429, 500, 503)[CAST(event_id % 12 AS INT) + 1] AS s FROM events) GROUP BY s""")
def status_actions(spark, d):
    codes = F.array(*map(F.lit, (200, 204, 400, 401, 402, 403, 404, 408, 422, 429, 500, 503)))
    rows = table(spark, d, "events").select(F.element_at(codes, (F.col("event_id") % 12 + 1).cast("int")).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("calls")).withColumn("action", requests.action(F.col("status")))


@query("""WITH items AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'required' ELSE 'preferred' END AS tier, p_name AS text FROM part),
kept AS (SELECT * FROM items WHERE p_partkey % 7 <> 0)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unclassified' ELSE tier END AS tier, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS part, unnest(parts) AS text,
  CASE WHEN p_partkey % 11 = 0 THEN 'split by you' WHEN p_partkey % 5 = 0 THEN 'edited by you' ELSE 'read' END AS source
FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN list_value('one', 'two') ELSE list_value(text) END AS parts FROM kept)
UNION ALL SELECT p_partkey + 1000000, 'required', 0, 'added', 'added by you' FROM part WHERE p_partkey % 50 = 0""")
def item_edits(spark, d):
    part = table(spark, d, "part")
    items = part.select("p_partkey", F.when(F.col("p_size") > 25, "required").otherwise("preferred").alias("tier"), F.col("p_name").alias("text"))
    edit = lambda n, op, tier, words: part.where(F.col("p_partkey") % n == 0).select("p_partkey", F.lit(op).alias("op"), F.lit(tier).cast("string").alias("tier"), F.lit(words).cast("string").alias("text"))
    added = edit(50, "add", "required", "added").withColumn("p_partkey", F.col("p_partkey") + 1000000)
    edits = edit(7, "delete", None, None).unionByName(edit(5, "set", "unclassified", None)).unionByName(edit(11, "split", None, "one|two")).unionByName(added)
    return requests.edited(items, edits, "p_partkey")


@query("""SELECT o_orderkey, sha256('{"lang":"' || o_orderpriority || '","doc":' || o_orderkey || '}') AS request_key FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity <= 10)""")
def cache_misses(spark, d):
    """Orders whose key isn't among those with a small item."""
    keyed = table(spark, d, "orders").select("o_orderkey", decide.request_key(F.col("o_orderpriority").alias("lang"), F.col("o_orderkey").alias("doc")).alias("request_key"))
    early = table(spark, d, "lineitem").where("l_quantity <= 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return requests.to_ask(keyed, keyed.join(early, "o_orderkey", "left_semi"), "request_key").select("o_orderkey", "request_key")


@query(_ANSWERS_SQL + """SELECT req_id, 'Your CV shows evidence for ' || count(*) FILTER (WHERE verdict = 'met') || ' of ' || count(*) || ' required items (' || count(*) FILTER (WHERE verdict = 'partial') || ' partly).'
  || CASE WHEN count(*) FILTER (WHERE verdict = 'unclear') > 0 THEN ' ' || count(*) FILTER (WHERE verdict = 'unclear') || ' can''t be judged from the CV.' ELSE '' END
  || coalesce(' Top gap: ' || coalesce(min(doc_id) FILTER (WHERE verdict = 'not_shown'), min(doc_id) FILTER (WHERE verdict = 'unclear')) || '.', '') AS headline
FROM verdicts WHERE tier = 'required' GROUP BY req_id""")
def headlines(spark, d):
    is_ = lambda v: F.col("verdict") == v
    first = lambda v: F.min(F.when(is_(v), F.col("doc_id")))
    rows = _verdicts(spark, d).where("tier = 'required'").groupBy("req_id")
    rows = rows.agg(F.count("*").alias("n"), *(F.count_if(is_(v)).alias(v) for v in ("met", "partial", "unclear")), F.coalesce(first("not_shown"), first("unclear")).alias("gap"))
    return rows.select("req_id", requests.headline(rows).alias("headline"))


@query(_ANSWERS_SQL + """SELECT kind, tier, count(*) AS items, count(*) FILTER (WHERE verdict = 'met') AS met FROM verdicts GROUP BY kind, tier""")
def ledger(spark, d):
    """Items by kind and tier: tiers are never mixed."""
    return _verdicts(spark, d).groupBy("kind", "tier").agg(F.count("*").alias("items"), F.count_if(F.col("verdict") == "met").alias("met"))


@query("""SELECT page_id, false AS ok, CASE page_id % 3 WHEN 0 THEN 'not_linkedin_job' WHEN 1 THEN 'no_job_id' ELSE 'unknown_layout' END AS failure, 'unknown' AS layout,
  CAST(CASE WHEN page_id % 3 = 2 THEN 6 ELSE 0 END AS INT) AS steps FROM pages""")
def posting_refusals(spark, d):
    """The job-posting reader on pages that are none, under addresses that are none, lack an id, or have one."""
    from pagewright.plans.posting import extract

    id_ = F.col("page_id")
    url = F.when(id_ % 3 == 0, F.col("url")).when(id_ % 3 == 1, "https://www.linkedin.com/jobs/").otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), id_.cast("string")))
    return extract(table(spark, d, "pages").withColumn("url", url)).select("page_id", "ok", "failure", "layout", F.size("health").alias("steps"))


#: (heading, whether a bullet, text; then for each statement of it: tier, its source, route, years, phrase, degree, certificate)
_STATED = (
    ("Requirements:", True, "5+ years of experience with Spark, or more", (("required", "heading", "assessed", 5, "Spark", False, False),)),
    ("What You’ll Bring", True, "Ideally 2 yrs with Go.", (("preferred", "cue", "assessed", 2, "Go", False, False),)),
    ("Bonus points", True, "You must hold a Bachelor degree", (("required", "cue", "assessed", None, None, True, False),)),
    ("Nice to have", False, "Certified Scrum master. Some Rust.", (("preferred", "heading", "assessed", None, None, True, True), ("preferred", "heading", "assessed", None, None, False, False))),
    ("Benefits", True, "Visa sponsorship and 10% travel", (("not_a_requirement", "heading", "eligibility", None, None, False, False),)),
    ("Other things", False, "Between 20 and 30 years old. A certificate at least", (("unknown", None, "excluded", 30, "old", False, False), ("required", "cue", "assessed", None, None, False, True))),
    ("MINIMUM QUALIFICATIONS", True, "Mustard and bonuses, mastery of visas", (("required", "heading", "assessed", None, None, False, False),)),
)
_quoted = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else f"'{x}'"
_STATED_SQL = ", ".join(f"({k}, {p}, {', '.join(map(_quoted, row))})" for k, (*_, found) in enumerate(_STATED) for p, row in enumerate(found))


@query(f"""SELECT c_custkey, part, tier, tier_source, route, CAST(min_years AS INT) AS min_years, phrase, degree, certificate FROM customer
JOIN (VALUES {_STATED_SQL}) AS t(k, part, tier, tier_source, route, min_years, phrase, degree, certificate) ON c_custkey % {len(_STATED)} = k""")
def stated_requirements(spark, d):
    """Statements under headings: tiers by heading and cue, bullets and sentences, years, routes, degrees and certificates."""
    case = F.element_at(F.array(*(F.struct(F.lit(h).alias("heading"), F.lit("bullet" if b else "paragraph").alias("kind"), F.lit(t).alias("text")) for h, b, t, _ in _STATED)), (F.col("c_custkey") % len(_STATED) + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", case.alias("c"))
    block = lambda pos, kind, words: F.struct(F.lit(pos).alias("pos"), kind.alias("kind"), words.alias("text"))
    # where a section has bullets, its paragraphs make no statements
    loose = F.array(block(2, F.lit("paragraph"), F.lit("Loose text, required.")))
    made = F.concat(F.array(block(0, F.lit("heading"), F.col("c.heading")), block(1, F.col("c.kind"), F.col("c.text"))), F.when(F.col("c.kind") == "bullet", loose).otherwise(F.slice(loose, 1, 0)))
    found = atoms.split_atoms(atoms.sections(rows.select("c_custkey", F.inline(made)), "c_custkey"), "c_custkey")
    return atoms.classify(found).select("c_custkey", "part", "tier", "tier_source", "route", "min_years", "phrase", "degree", "certificate")
