"""Importance resampling: composed CRCs against those of strings, results against a plain reading of the rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def grams(text, max_n):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def test_crcs_combine():
    rng = random.Random(0)
    a, b = ([rng.randbytes(rng.choice([0, 1, 3, 70, 5000])) for _ in range(300)] for _ in range(2))
    crc = lambda rows: np.array([zlib.crc32(x) for x in rows], np.uint32)
    assert resample.combined(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == crc([x + y for x, y in zip(a, b)]).tolist()


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_ngrams_by_segments(max_n, size):
    rng = random.Random(max_n)
    for _ in range(60):
        text = "".join(rng.choice("aB9 é中.\n-İ\x00") for _ in range(rng.randint(0, 60)))
        n, crcs = 0, []
        for k, found in resample.features(text.encode(), max_n, size):
            n += k
            crcs += found.tolist()
        assert n == len(words_of(text))
        assert sorted(crcs) == sorted(zlib.crc32(g.encode()) for g in grams(text, max_n)), text


def brute(docs, target, max_n, buckets, least, percent, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, max_n))
    t = Counter(bucket(g) for x in target for g in grams(x, max_n))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(text, max_n))
        rows.append([doc_id, len(words_of(text)), len(grams(text, max_n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(may):
        r.append(i + 1 if i < percent * len(may) // 100 else None)
    return [tuple(r) if len(r) == 6 else (*r, None) for r in rows]


@pytest.mark.parametrize("max_n,least,percent", [(1, 20, 10), (2, 3, 50), (3, 0, 100)])
def test_equals_brute_force(spark, max_n, least, percent):
    rng = random.Random(least)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "中文", "A-b"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
    docs = [(i, text()) for i in range(300)] + [(None, text()), (None, None), (500, ""), (501, "a " * 30_000)]
    docs += [(600, "same text of these rows " * 6)] * 150
    target = [text() for _ in range(20)] + [None]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, _nth int").repartition(6)
    out = resample.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), max_n, 1000, least, percent)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, brute(docs, target, max_n, 1000, least, percent, 2024)))


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert resample.resampled(docs.limit(0), target).count() == 0
    assert resample.resampled(docs, target.limit(0)).count() == 1
