"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed into 2**BITS features: its words (runs of letters, lower case) and the words'
first STEMS letters, so that inflected forms share evidence. The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>, so that two terms together can count for more than both alone, and a
logistic link gives the score. Factors are given to terms that go with a label more than chance allows (Z_TERM standard
deviations); the pairs of all others are so many in a long text that they would only add noise. The machine is fitted on the
driver by AdaGrad, on at most SAMPLE labelled rows whose features the executors have made; what is broadcast is a number and
FACTORS more for each term that the sample has often, 2**BITS of them at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, crc_mod, first_by_hash

BITS = 20
FACTORS = 4
STEMS = (4, 5)
#: A term counts if so many rows of the sample have it; fewer in a small sample, 1 row in MIN_SHARE.
MIN_ROWS = 8
MIN_SHARE = 500
#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 12_000
EPOCHS = 8
RATE_W, L2_W = 0.1, 5e-3
RATE_V, L2_V, START_V = 0.2, 1e-3, 0.05
Z_TERM = 4.0
BATCH = 32
#: One row in TUNE of the sample isn't fitted on; the bias is set on those, where the fewest of them are misjudged.
TUNE = 5
#: What an error on a toxic row weighs against one on a clean row, which are many more.
WEIGHT = 2.0
FOLDS = 5
HELD_OUT = 0

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text, ascending; none for a null or wordless text."""
    terms = set(_WORD.findall((text or "").lower()))
    for n in STEMS:
        terms |= {t[:n] + "*" for t in terms if len(t) > n and t[-1] != "*"}
    mask = (1 << BITS) - 1
    return np.array(sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask for t in terms}), dtype=np.int32)


@dataclass
class Machine:
    """ids: the terms that count, ascending; w and v: a row for each."""

    w0: float
    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logit(self, terms: np.ndarray) -> float:
        if not len(terms) or not len(self.ids):
            return self.w0
        at = np.minimum(np.searchsorted(self.ids, terms), len(self.ids) - 1)
        at = at[self.ids[at] == terms]
        v = self.v[at].astype(float)
        s = v.sum(axis=0)
        return float(self.w0 + self.w[at].sum(dtype=float) + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(features(text)), -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, pairs: bool = True) -> Machine:
    """Fits by AdaGrad on the log loss; without `pairs` the linear part alone.

    Without rows, or with one label only, the machine gives the label's share.
    """
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w0 = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int32)
    if not len(rows) or labels.min() == labels.max():
        return Machine(w0, none, np.zeros(0), np.zeros((0, FACTORS)))
    ids, many = np.unique(np.concatenate(rows), return_counts=True)
    often = many >= min(MIN_ROWS, 2 + len(rows) // MIN_SHARE)
    ids, many = ids[often], many[often]
    if not len(ids):
        return Machine(w0, none, np.zeros(0), np.zeros((0, FACTORS)))
    rows = [np.flatnonzero(np.isin(ids, x, assume_unique=True)) for x in rows]
    toxic = np.bincount(np.concatenate([x for x, y in zip(rows, labels, strict=True) if y > 0]), minlength=len(ids))
    p = labels.mean()
    telling = pairs & (abs(toxic - many * p) >= Z_TERM * np.sqrt(many * p * (1 - p)))
    w, v = np.zeros(len(ids)), rng.normal(0, START_V, (len(ids), FACTORS)) * telling[:, None]
    gw, gv, g0 = np.full(len(ids), 1e-2), np.full((len(ids), FACTORS), 1e-2), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            term = np.concatenate([rows[i] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            own = telling[term]
            pair, pair_row = term[own], row[own]
            vi = v[pair]
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, pair_row, vi)
            squares = np.bincount(pair_row, (vi * vi).sum(axis=1), len(some))
            z = w0 + np.bincount(row, w[term], len(some)) + 0.5 * ((s * s).sum(axis=1) - squares)
            y = labels[some]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, WEIGHT, 1.0)
            e = err / len(some)
            at, back = np.unique(term, return_inverse=True)
            dw = np.bincount(back, e[row], len(at)) + L2_W * w[at]
            gw[at] += dw * dw
            w[at] -= RATE_W * dw / np.sqrt(gw[at])
            at, back = np.unique(pair, return_inverse=True)
            push = e[pair_row][:, None] * (s[pair_row] - vi)
            dv = np.stack([np.bincount(back, push[:, k], len(at)) for k in range(FACTORS)], axis=1) + L2_V * v[at]
            gv[at] += dv * dv
            v[at] -= RATE_V * dv / np.sqrt(gv[at])
            d0 = float(err.mean())
            g0 += d0 * d0
            w0 -= RATE_W * d0 / np.sqrt(g0)
    return Machine(w0, ids, w.astype(np.float32), v.astype(np.float32))


def calibrated(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fits on four fifths of the rows and moves the bias to where the logits of the others part best."""
    own = np.arange(len(rows)) % TUNE == 0
    if len(rows) < 10 * TUNE or labels[own].min() == labels[own].max():
        return fit(rows, labels)
    machine = fit([x for x, k in zip(rows, own, strict=True) if not k], labels[~own])
    z, y = np.array([machine.logit(x) for x, k in zip(rows, own, strict=True) if k]), labels[own]
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    machine.w0 -= float(np.median(edges[wrong == wrong.min()]))
    return machine


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(0), batch.column(2)], names=["idx", "label", "doc_id"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits a machine on at most `sample` labelled documents outside the held-out fold, those with the least hash of doc_id."""
    bounded_batches(docs.sparkSession)
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    marked = marked.join(F.broadcast(first_by_hash(marked, "doc_id", sample)), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = text.join(F.broadcast(marked), "doc_id").select("label", "text", "doc_id").mapInArrow(_feature_batches, "idx binary, label int, doc_id long")
    rows = made.groupBy("doc_id").agg(F.min("idx").alias("idx"), F.first("label").alias("label")).collect()  # one row of an id that repeats
    rows = sorted((zlib.crc32(r.idx), bytes(r.idx), r.label) for r in rows)  # an order that doesn't follow the text
    return calibrated([np.frombuffer(x, np.int32) for _, x, _ in rows], np.array([y for *_, y in rows], dtype=float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with `toxicity` (0 to 1) appended, or in place of a column of that name; all rows and columns stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts):
        own = model.value
        return texts.map(lambda t: own.score(t))

    return docs.withColumn("toxicity", score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    A null text counts as empty and gets the machine's base rate. held_out is null where doc_id is. Labels of documents that
    don't occur, null labels and repeated labels (the greatest counts) do no harm. An empty table gives no rows.
    """
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is under 0.5, with the columns of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, sample))

    @F.pandas_udf("double")
    def score(texts):
        own = model.value
        return texts.map(lambda t: own.score(t))

    return docs.where(score(F.col("text").cast("string")) < 0.5)
