"""The pipeline's decisions on planted documents, and its queries' SQL."""

import os
import random
import sys

import pytest

import corpus_pipeline
from pagewright.llm import decontaminate, queries, secrets, simhash, toxicity


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    known = [word() for _ in range(60)]
    texts = {i: " ".join(rng.choice(known) for _ in range(rng.randint(40, 90))) for i in range(240)}
    toxic = {i for i in texts if i % 4 == 0}
    for i in toxic:
        words = texts[i].split()
        words.insert(rng.randrange(len(words)), "grubble")
        texts[i] = " ".join(words)
    texts[301], texts[302] = texts[1], texts[2] + " "
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    texts[5] = texts[5] + " " + items[2][1] + " " + texts[6][:50]
    texts[7] = "password=abcdefghijkl1 " + texts[7]
    rows = [(i, t, "en", "s", len(t), None) for i, t in texts.items()] + [(400, None, None, None, None, "x"), (401, "", "en", "s", 0, "x")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic


def test_stages_take_effect(spark, planted):
    d, toxic = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids, had = {r.doc_id for r in docs.collect()}, docs.columns
    docs = corpus_pipeline.STAGES[0][1](spark, docs, d)
    rows = docs.collect()
    clean = {r.doc_id for r in rows}
    assert docs.columns == had and len((ids - toxic) ^ clean) <= 0.03 * len(ids) and {1, 2, 5, 7, 301, 302, 400, 401} <= clean
    docs = spark.createDataFrame(rows, docs.schema)
    left = [clean - {301, 302, 401}, clean - {301, 302, 401, 5}, clean - {301, 302, 401, 5}]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[1:-1], left, strict=True):
        docs = stage(spark, docs, d)
        rows = docs.collect()
        assert docs.columns == had, name
        assert {r.doc_id for r in rows} == expected, name
        docs = spark.createDataFrame(rows, docs.schema)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[7].startswith("[REDACTED] ")
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left[-1]


def test_each_stage_equals_its_operator_on_the_same_input(spark, planted):
    d, _ = planted
    docs, labels, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    f = dict(corpus_pipeline.STAGES)
    assert ids(f["toxicity"](spark, docs, d)) == ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
    assert ids(f["near_dedup"](spark, docs, d)) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
    hit = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(ids(f["decontamination"](spark, docs, d))) == set(ids(docs)) - hit
    found = {r.doc_id for r in secrets.secrets(docs).where("spans <> ''").collect()}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, f["secret_scan"](spark, docs, d)))
    assert {i for i in before if before[i] != after[i]} == found


def test_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert "corpus_pipeline" in sys.modules and corpus_pipeline.ORACLE_SQL is None


def test_chat_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", None), (2, 5, "system\n", "[INST]"), (2, 5, "assistant", "~<~|im_end|>"), (2, 6, "assistant", "é\U0001f600")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = queries.op2_chat(spark, str(tmp_path))
    expected = con.execute(queries.oracle_sql()["op2_chat"]).fetchall()
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(r[c] for c in cols) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("name", ["op11_codes", "op12_mixture", "op13_resample"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in df.description]
    found = queries.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=str) == sorted(df.fetchall(), key=str)


def test_redaction_learns_from_all_documents(spark, monkeypatch):
    """More values than a sample would hold: each is among the labelled lengths, and none is left in the texts."""
    docs = spark.createDataFrame([(k, f"see {k * 7919 + 2**60:x}00 there") for k in range(500)], "doc_id long, text string")
    used = []
    redacted = secrets.redacted
    monkeypatch.setattr(secrets, "redacted", lambda docs, grammars: used.append(grammars) or redacted(docs, grammars))
    out = corpus_pipeline.redact_secrets(spark, docs, "").collect()
    assert {r.text for r in out} == {"see [REDACTED] there"} and len(out) == 500
    assert sum(used[0].automata["hex"].lengths.values()) == 500
