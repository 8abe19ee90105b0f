"""Codes by heaps of bounds, against Lloyd's algorithm that scans everything."""

import hashlib

import numpy as np
import pytest

from pagewright.llm import quantize


def brute(vectors, parts, entries, rounds):
    """(codes, errors, codebooks) of the vectors, ascending by id."""
    x = np.clip(np.floor(np.array(vectors, float) * 1024), -(1 << 26), 1 << 26).astype(np.int64)
    width = x.shape[1] // parts
    x = x.reshape(len(x), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = np.array([((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)])
        return d.argmin(2), d.min(2).sum(0)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in set(at[p].tolist()):
                books[p, e] = [int(s) // int((at[p] == e).sum()) for s in x[at[p] == e, p].sum(0)]
    at, error = assign()
    return ["".join(f"{e:02x}" for e in row) for row in at.T], error.tolist(), books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


@pytest.mark.parametrize("seed,scale", [(0, 0.2), (1, 0.004), (2, 3000.0)])
def test_equals_brute_force(spark, seed, scale):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (30, 16))
    vectors = (centres[rng.integers(0, 30, 700)] + rng.normal(0, scale / 4, (700, 16))).astype(np.float32)
    vectors[100:300] = vectors[5]  # a group of copies, ties among the first entries too
    vectors[7] = vectors[5]
    labels = [None if i % 5 == 0 else i % 3 for i in range(700)]
    rows = frame(spark, [(i, v.tolist(), y, "clash") for i, (v, y) in enumerate(zip(vectors, labels))]).repartition(5)
    out = quantize.compressed(rows, entries=64).orderBy("vec_id").toPandas()
    codes, error, books = brute(vectors, 4, 64, 4)
    assert out.code.tolist() == codes and out.error.tolist() == error
    sums = {y: sum(e for e, z in zip(error, labels) if z == y) for y in set(labels)}
    assert out.label_error.tolist() == [sums[y] for y in labels]
    assert set(out.codebooks_sha256) == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


def test_only_violated_parts_are_scanned_again():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 900, (40, 8))[rng.integers(0, 40, 2000)] + rng.normal(0, 150, (2000, 8))).astype(np.int64)
    book = x[:40].copy()
    heaps, drift, looked = quantize.Heaps(len(x), 40), np.zeros((1, 40)), []
    for _ in range(12):
        reached = (heaps.keys <= (drift[0] * (1 + quantize.SLACK))[heaps.entry[heaps.members]]).sum() if looked else len(x)
        looked.append(len(heaps.step(x, book, drift[0])))
        assert looked[-1] == reached
        assert (heaps.entry == quantize.distances(x, book).argmin(1)).all()
        for keys, members in heaps.heaps().values():  # each is a heap, of the parts of its entry
            assert all(keys[i] >= keys[(i - 1) // 2] for i in range(1, len(keys)))
        assert sorted(heaps.members.tolist()) == list(range(len(x)))
        new = np.array([x[heaps.entry == e].sum(0) // max(1, (heaps.entry == e).sum()) if (heaps.entry == e).any() else book[e] for e in range(40)])
        drift, book = drift + quantize.drifted(book[None], new[None]), new
    assert looked[-1] < len(x) / 4


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (1000, 1 << 25):
        x, b = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (9, 16))
        assert quantize.distances(x, b).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(r, s)) for s in b] for r in x]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 2.0, 3.0, 4.0], 1, ""), (3, [1.0, 2.0, 3.0, 4.0], 1, ""), (None, [-1.0, -2.0, 0.5, 9e9], None, ""), (4, None, 1, ""), (5, [1.0, None, 2.0, 3.0], 1, ""),
        (6, [nan, 1.0, 1.0, 1.0], 1, ""), (7, [1.0, inf, 1.0, 1.0], 1, ""), (8, [1.0, 2.0], 1, ""), (9, [], 1, ""), (1, [0.0, -0.001, 0.0, 0.0], None, ""),
    ]
    out = sorted(quantize.compressed(frame(spark, rows)).collect(), key=str)
    assert sorted((r.vec_id for r in out), key=str) == [1, 3, 3, None]
    assert {r.vec_id: r.code for r in out} == {1: "00000000", 3: "01010101", None: "03030303"} and {r.error for r in out} == {0}
    assert quantize.compressed(frame(spark, rows[:0])).count() == 0
    assert quantize.compressed(frame(spark, rows[3:4])).count() == 0
    assert quantize.compressed(frame(spark, [(1, [1.0, 2.0, 3.0], 1, "")])).count() == 0
