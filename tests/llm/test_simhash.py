import random
import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import simhash

DOCS = "doc_id long, text string, extra string, fp string"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Two words", "A b c d É é", "x\x0by\x0cz " * 500, "a " * 200_000])
def test_fingerprint(text):
    assert simhash.simhash(None if text is None else text.encode()) == brute(text)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_equal_brute_force(spark, hot):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:40]:
        for _ in range(rng.randint(1, 12)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    signed = [int(x) for x in np.array(prints, np.uint64).view(np.int64)]
    expected = classes(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    rows = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)).collect()
    at = {s: i for i, s in enumerate(signed)}
    root = {at[r.node]: at[r.root] for r in rows}
    found = {i: root.get(i, i) for i in range(len(prints))}
    pairs = lambda c: {(i, j) for i in c for j in c if i < j and c[i] == c[j]}
    assert pairs(found) == pairs(expected)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "", ""), (3, base + " end", "", ""), (9, None, "", ""), (8, "", "", ""), (7, "quite another text altogether here", "", ""), (7, "quite another text altogether here", "", ""), (None, "lonely words of no id", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    near = (simhash.simhash(rows[0][1].encode()) ^ simhash.simhash(rows[1][1].encode())).bit_count() <= 3
    assert out == [(-1, None), (3, 3), (5, 3 if near else 5), (7, 7), (7, 7), (8, 8), (9, 8)]
    for most in (simhash.BROADCAST_IDS, 0):
        kept = simhash.keep_one(docs, most)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", *["5"] * (not near), "7", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
