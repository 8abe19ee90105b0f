"""Mixtures: targets against repeated sharing out, splits against their distribution, words taken against the targets."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import mixture


def shared(sizes, weights):
    """Targets by sharing out again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: rest * weight[s] / total for s in free}
        for s in above:
            target[s] = 3 * sizes[s]
            rest -= 3 * sizes[s]
        free -= above


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken string")


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "", None, "tiny", "Z"]
    pick = lambda: "b" if rng.random() < 0.4 else rng.choice(sources[:-2]) if rng.random() < 0.98 else rng.choice(["tiny", "Z"])
    return [(i, "w \t" * int(rng.paretovariate(0.9)) if rng.random() < 0.95 else None, pick(), "clash", None) for i in range(n)]


@pytest.mark.parametrize("seed,block", [(1, 50), (2, 300), (3, 32_768)])
def test_words_taken(spark, seed, block, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_WORDS", block)
    rows = corpus(seed)
    out = {r.doc_id: r for r in mixture.taken(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    sizes, docs = Counter(), defaultdict(list)
    for i, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
        docs[source].append(out[i])
    want = shared(sizes, (5, 2, 1))
    for source, own in docs.items():
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(want[source]) for r in own)
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in own)
        assert len({r.taken // r.size for r in own if r.size}) <= 2
        often = max((r.taken // r.size for r in own if r.size), default=0)
        spare = [r.size for r in own if r.size and r.taken < often * r.size]
        if block > 1000:  # all of a source is one block, of which as much as fits is taken
            assert abs(sum(r.taken for r in own) - want[source]) <= max(1, min(spare, default=0) / 2 + 0.5)
    assert sorted(out.items()) == sorted((r.doc_id, r) for r in mixture.taken(frame(spark, rows).repartition(7)).collect())


def test_the_mix_itself(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixture, "SHARD_BLOCKS", 8)
    rows = frame(spark, corpus(5))
    out = mixture.mixed(rows).toPandas()
    took = out.groupby("doc_id")["size"].sum()
    for r in mixture.taken(rows).collect():
        assert r.taken == took.get(r.doc_id, 0)
    assert out.shard.nunique() > 4
    for _, own in out.groupby("shard"):
        assert sorted(own.position) == list(range(1, len(own) + 1))
    assert not out.duplicated(["doc_id", "copy"]).any()


def test_quotas_are_split_whole(spark):
    counts = {1: 700, 2: 90, 3: 5, 4: 0, 5: 1205}
    draws = spark.createDataFrame([(s, n - 1) for s, n in counts.items() if n], "source_id long, draw long")
    out = mixture.shard_quotas(draws, 16).toPandas()
    assert set(out.shard) == set(range(125)) and (out.groupby("shard")["count"].sum() == 16).all()
    for s, own in out.sort_values("shard").groupby("source_id"):
        assert own["count"].sum() == counts[s]
        assert own["first"].tolist() == own["count"].cumsum().shift(fill_value=0).tolist()  # disjoint and gapless
    spread = out[out.source_id == 5]["count"]
    assert 2 < spread.var() < 8  # 3.8 of a blind draw of 16


@pytest.mark.parametrize("total,marked,drawn", [(20, 8, 7), (1000, 400, 30), (9, 9, 4), (9, 4, 9), (50, 1, 25), (6, 0, 3)])
def test_splits_follow_the_distribution(spark, total, marked, drawn):
    n = 4000
    u = (F.col("id") + 0.5) / n
    made = spark.range(n).select(mixture.hypergeometric(*(F.lit(x).cast("long") for x in (total, marked, drawn)), u).alias("k")).groupBy("k").count()
    found = {r.k: r["count"] / n for r in made.collect()}
    for k in range(min(marked, drawn) + 1):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) if drawn - k <= total - marked else 0
        assert found.get(k, 0) == pytest.approx(p, abs=2 / n)


def test_equal_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "s", "", "")] * 2500 + [(None, "x " * 10, None, "", "")] * 30 + [(2, "", "empty", "", ""), (3, None, "empty", "", "")]
    out = mixture.taken(frame(spark, rows)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    assert (out[out["size"] == 0].target == 0).all() and (out[out["size"] == 0].taken == 0).all()
    for _, own in out[out["size"] > 0].groupby("size"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].iloc[0]
    assert mixture.taken(frame(spark, rows[:0])).count() == 0 and mixture.mixed(frame(spark, rows[:0])).count() == 0
    assert mixture.taken(frame(spark, rows[-2:])).toPandas().taken.tolist() == [0, 0]


def test_sources_beyond_the_broadcast(spark, monkeypatch):
    rows = frame(spark, corpus(8, 120))
    want = sorted(map(str, mixture.taken(rows).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixture.taken(rows).collect())) == want


def test_sql_takes_the_same(spark):
    rows = corpus(9) + [(7, "same words here", "b", "", "")] * 1200
    con = duckdb.connect()
    documents = frame(spark, rows).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841  named in the SQL
    found = con.sql(mixture.ORACLE).df()
    out = mixture.taken(frame(spark, rows)).toPandas()[found.columns.tolist()]
    assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, found.values.tolist()))
