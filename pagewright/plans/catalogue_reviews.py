"""Queries on reviews, edits, histories and source scans; answers that the standard tables lack are derived from ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import privacy, text
from pagewright.operators import decide, requests
from pagewright.plans.catalogue import _ANSWERS_SQL, _answers, query, table
from pagewright.sources import scan


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'reject' WHEN event_id % 5 = 0 THEN 'review' ELSE 'use' END AS use,
  CASE WHEN event_id % 5 = 0 THEN 'no confidence' WHEN (event_id % 100)::DOUBLE / 100 BETWEEN 0.30 AND 0.70 THEN 'in the band' WHEN (event_id % 90)::DOUBLE / 90 < 0.60 THEN 'split' END AS review FROM events""")
def missing_confidence(spark, d):
    """Every seventh answer has no cost, every fifth no confidence."""
    id_ = F.col("event_id")
    confidence = F.when(id_ % 5 != 0, (id_ % 100).cast("double") / 100)
    use = requests.usable(confidence, F.when(id_ % 7 != 0, F.lit(0.1)))
    return table(spark, d, "events").select("event_id", use.alias("use"), requests.reviewed(confidence, (id_ % 90).cast("double") / 90).alias("review"))


_POINTS = """points AS (SELECT doc_id, (doc_id * 7 % 100)::DOUBLE / 100 AS p_none, (doc_id * 3 % 40)::DOUBLE / 100 AS p_a, (doc_id * 5 % 30)::DOUBLE / 100 AS p_b, (doc_id * 11 % 100)::DOUBLE / 100 AS there FROM documents)"""


def _points(spark, d) -> DataFrame:
    id_ = F.col("doc_id")
    share = lambda k, n: (id_ * k % n).cast("double") / 100
    probs = F.map_from_arrays(F.array(*map(F.lit, ("none", "a", "b"))), F.array(share(7, 100), share(3, 40), share(5, 30)))
    return table(spark, d, "documents").select("doc_id", probs.alias("probs"), share(11, 100).alias("p"))


@query(f"WITH {_POINTS} SELECT doc_id, (p_none > p_a AND p_none > p_b) OR (p_a < 0.15 AND p_b < 0.15) AS needs_check FROM points WHERE p_none <> p_a AND p_none <> p_b")
def evidence_checks(spark, d):
    """Answers without evidence that could be shown; those in which `none` ties aren't looked at."""
    own = _points(spark, d).where((F.col("probs")["none"] != F.col("probs")["a"]) & (F.col("probs")["none"] != F.col("probs")["b"]))
    return own.select("doc_id", decide.needs_check(F.col("probs")).alias("needs_check"))


@query(f"WITH {_POINTS} SELECT doc_id, CASE WHEN there > 0.70 THEN CASE WHEN p_a >= p_b THEN 'a' ELSE 'b' END END AS line_id FROM points")
def trusted_pointers(spark, d):
    own = _points(spark, d)
    return decide.trusted(own.select("doc_id", "probs"), own.select("doc_id", "p"), "doc_id").select("doc_id", "line_id")


@query("""WITH spans AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 90 AS stop, o_orderkey % 10 >= 7 AS counts FROM orders),
marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans WHERE counts),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked),
days AS (SELECT o_custkey, sum(d) AS d FROM (SELECT o_custkey, max(stop) - min(start) AS d FROM islands GROUP BY o_custkey, island) GROUP BY o_custkey)
SELECT c.o_custkey, round(coalesce(d, 0) / 365.25, 4) AS years FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN days USING (o_custkey)""")
def counted_years(spark, d):
    """Years of the roles whose answer is 0.70 at least."""
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), ((F.col("o_orderkey") % 10).cast("double") / 10).alias("p"))
    found = decide.role_years(rows.withColumn("stop", F.date_add("start", 90)), "o_custkey", "start", "stop", "p")
    return found.select("o_custkey", F.round("years", 4).alias("years"))


@query("""WITH runs AS (SELECT user_id, event_id, CASE WHEN event_id % 10 < 3 THEN 0 WHEN event_id % 10 > 7 THEN 2 ELSE 1 END AS side FROM events),
moved AS (SELECT *, side <> lag(side) OVER (PARTITION BY user_id ORDER BY event_id) AS moved FROM runs)
SELECT user_id, count(*) AS runs, round(count(*) FILTER (WHERE moved)::DOUBLE / nullif(count(*) - 1, 0), 6) AS crossed FROM moved GROUP BY user_id""")
def band_crossings(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") % 10).cast("double") / 10).alias("p"))
    return decide.crossings(rows, "user_id", "event_id", "p").withColumn("crossed", F.round("crossed", 6))


@query("""SELECT event_id, CAST(event_id % 3 = 0 AS BIGINT) AS missing, CAST(event_id % 4 = 0 AS BIGINT) + CAST(event_id % 5 = 0 AS BIGINT) AS mistyped,
  event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 AS ok FROM events""")
def typed_responses(spark, d):
    """Three questions for each event: one is left out of every third, two have answers of another type in every fourth and fifth."""
    rows = table(spark, d, "events").select("event_id")
    each = lambda *entries: F.inline(F.array(*(F.struct(F.lit(q).alias("question"), x.alias("x")) for q, x in entries)))
    id_ = F.col("event_id")
    expected = rows.select("event_id", each(("a", F.lit("number")), ("b", F.lit("string")), ("c", F.lit("object")))).withColumnRenamed("x", "type")
    texts = F.when(id_ % 3 != 0, F.lit("1.5")), F.when(id_ % 4 == 0, F.lit("7")).otherwise(F.lit('"yes"')), F.when(id_ % 5 == 0, F.lit("[1]")).otherwise(F.lit('{"p": 1}'))
    answered = rows.select("event_id", each(*zip("abc", texts, strict=True))).where("x IS NOT NULL").withColumnRenamed("x", "answer")
    return decide.valid(expected, answered, "event_id", "question")


@query("""SELECT r.o_orderkey, a.p_partkey, a.min_years FROM (SELECT o_orderkey, o_custkey % 50 AS req FROM orders WHERE o_orderkey % 20 = 0) r
JOIN (SELECT p_partkey, p_partkey % 50 AS req, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 9 AS INT) END AS min_years FROM part WHERE p_partkey % 10 = 3) a USING (req) WHERE min_years IS NOT NULL""")
def role_questions(spark, d):
    """A question for each role and requirement of years of the same request."""
    roles = table(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_orderkey", (F.col("o_custkey") % 50).alias("req"))
    years = F.when(F.col("p_size") % 3 == 0, (F.col("p_size") % 9).cast("int"))
    atoms = table(spark, d, "part").where("p_partkey % 10 = 3").select("p_partkey", (F.col("p_partkey") % 50).alias("req"), years.alias("min_years"))
    return requests.role_requirements(roles, atoms, "req").select("o_orderkey", "p_partkey", "min_years")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'tool' ELSE p_brand END AS kind,
  CASE WHEN p_partkey % 10 = 1 AND next IS NOT NULL THEN p_name || ' ' || next ELSE p_name END AS text, CASE WHEN p_partkey % 15 = 0 THEN 0 ELSE p_size END AS pos,
  coalesce(nullif(concat_ws(', ', CASE WHEN p_partkey % 10 = 1 AND next IS NOT NULL THEN 'merged by you' END, CASE WHEN p_partkey % 6 = 0 THEN 'edited by you' END, CASE WHEN p_partkey % 15 = 0 THEN 'moved by you' END), ''), 'read') AS source
FROM (SELECT p.*, q.p_name AS next FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1) WHERE p_partkey % 10 <> 2 OR p_partkey < 2""")
def item_rearrangements(spark, d):
    """Every item whose key ends in 2 is merged into the one before it; some are moved or get another kind."""
    part = table(spark, d, "part")
    items = part.select("p_partkey", F.col("p_brand").alias("kind"), F.col("p_name").alias("text"), F.col("p_size").alias("pos"))
    edit = lambda where, op, target, kind: part.where(where).select("p_partkey", F.lit(op).alias("op"), target.cast("long").alias("target"), F.lit(kind).cast("string").alias("kind"))
    edits = edit("p_partkey % 10 = 2", "merge", F.col("p_partkey") - 1, None).unionByName(edit("p_partkey % 6 = 0 AND p_partkey % 10 <> 2", "kind", F.lit(None), "tool"))
    edits = edits.unionByName(edit("p_partkey % 15 = 0", "move", F.lit(0), None))
    return requests.rearranged(items, edits, "p_partkey").withColumn("pos", F.col("pos").cast(part.schema["p_size"].dataType))


@query("""SELECT event_id, user_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS changed FROM events""")
def model_snapshots(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id"), "user_id", F.col("event_id").alias("at"), F.col("event_type").alias("model"))
    return scan.latest_model(rows, "user_id").select("event_id", "user_id", "changed")


@query(_ANSWERS_SQL + "SELECT doc_id, CASE WHEN top >= 0.60 THEN coverage ELSE 'unclassified' END AS settled FROM answers")
def settled_choices(spark, d):
    return _answers(spark, d).select("doc_id", decide.settled(F.col("probs")).alias("settled"))


@query("""SELECT c_custkey, trim(regexp_replace(replace(replace('Dear ' || c_name || ' of ' || c_mktsegment || ', hello', c_name, ''), c_mktsegment, ''), ' +', ' ', 'g')) AS text FROM customer""")
def confirmed_strings(spark, d):
    """Lines without the names that the owner has confirmed."""
    line = F.concat(F.lit("Dear "), "c_name", F.lit(" of "), "c_mktsegment", F.lit(", hello"))
    removed = privacy.remove_strings(line, F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit(""), F.lit(None).cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.normalize_text(removed).alias("text"))


@query("SELECT p_partkey, p_partkey % 4 < 3 AS withheld FROM part")
def protected_lines(spark, d):
    """Lines that name a protected attribute, and lines that hold its letters only."""
    id_ = F.col("p_partkey")
    named = F.element_at(F.array(*map(F.lit, privacy.PROTECTED)), (id_ % len(privacy.PROTECTED) + 1).cast("int"))
    line = F.when(id_ % 4 == 0, named).when(id_ % 4 == 1, F.concat(F.lit("My "), F.upper(named), F.lit(": 12"))).when(id_ % 4 == 2, F.concat(named, F.lit(", as asked"))).otherwise("teenagers manage agendas")
    return table(spark, d, "part").select("p_partkey", privacy.protected(line).alias("withheld"))
