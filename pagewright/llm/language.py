"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of hashed byte n-grams (1 to 3 bytes of the lower-cased text, everything but letters and the marks on
them being one space). Weights are (1 + ln tf) * idf, scaled to length one; document frequencies are counted over all documents
outside the held-out fold. Each language gets several centroids, from spherical k-means on a
bounded sample of its labelled texts; a text has the language of the centroid with the greatest cosine. A text is rejected
if it is farther from its centroid than nearly all of the sample's texts were from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import ample, bounded_batches, crc_mod, hash_share, stored

BUCKETS = 1 << 13
CENTROIDS = 3
#: Labelled texts per language that centroids are fitted on, at most; fewer, LEAST at least, where there are so many languages that TOTAL would be passed.
SAMPLE = 600
TOTAL = 20_000
LEAST = 20
#: Languages whose counts are broadcast, at most; beyond, documents are joined by shuffling.
BROADCAST_LANGUAGES = 100_000
ROUNDS = 12
#: A text is rejected if its cosine is under this quantile of the sample's, less SLACK.
QUANTILE = 0.001
SLACK = 0.1
FOLDS = 3
HELD_OUT = 1
UNKNOWN = "und"
#: Bytes of a text counted at once.
CHUNK = 1 << 20

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a whole text's n-grams; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    letters = _OTHER.sub(" ", text).strip()
    data = np.frombuffer(f" {letters.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), CHUNK):
        x = data[max(0, at - 2) : at + CHUNK].astype(np.uint32)
        skip = min(at, 2)
        one, two, three = x[skip:], x[1:] * 256 + x[:-1], (x[2:] * 256 + x[1:-1]) * 256 + x[:-2]
        for gram, seed in ((one, 1), (two[max(0, skip - 1) :], 2), (three, 3)):
            mixed = (gram + np.uint32(seed << 28)) * np.uint32(2654435761)
            total += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx]


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine of each language

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); und, 0 and True if there is no letter or nothing was learned."""
        found = counts(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0, True
        idx, tf = found
        x = (1 + np.log(tf)) * self.idf[idx]
        cos = self.centroids[:, idx] @ x / max(float(np.sqrt(x @ x)), 1e-12)
        best = int(np.argmax(cos))
        lang = int(self.owner[best])
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[lang], score, bool(score < self.floor[lang])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of unit rows."""
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray | None = None, n: int | None = None, seed: int = 5) -> Model:
    """rows: (language, buckets, counts); df: documents that have each bucket, of n; of the rows, where it isn't given."""
    if df is None:
        df, n = np.zeros(BUCKETS), len(rows)
        for _, idx, _ in rows:
            df[idx] += 1
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    names, owner, centres, floor = sorted({r[0] for r in rows}), [], [], []
    for n, name in enumerate(names):
        own = [r for r in rows if r[0] == name]
        x = np.zeros((len(own), BUCKETS), np.float32)
        for i, (_, idx, tf) in enumerate(own):
            x[i, idx] = (1 + np.log(tf)) * idf[idx]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = kmeans(x, CENTROIDS, rng)
        centres.append(c)
        owner += [n] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(axis=1), QUANTILE)) - SLACK)
    return Model(names, np.array(owner, int), np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32), idf, np.array(floor))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [counts(t) for t in batch.column(1).to_pylist()]
        idx = pa.array([None if m is None else m[0].tobytes() for m in made], pa.binary())
        tf = pa.array([None if m is None else m[1].tobytes() for m in made], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), idx, tf, batch.column(2)], names=["lang", "idx", "tf", "doc_id"])


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents that have it) of a task; bucket -1 counts the documents that have any."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = counts(text)
            if found is not None:
                df[found[0]] += 1
                n += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([n, *df[some].tolist()], pa.int64())], names=["bucket", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` texts per language outside the held-out fold, those with the least hash of doc_id.

    Rows are first thinned by a share of hashes for each language, so that no task gets a language whole. Where ids repeat, as
    many fewer texts are found. Null ids, texts and languages teach nothing.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows_of = stored(own.groupBy("lang").agg(F.count("*").alias("rows")))
    languages = max(1, rows_of.count())
    sample = min(sample, max(LEAST, TOTAL // languages))
    if languages <= BROADCAST_LANGUAGES:
        rows_of = F.broadcast(rows_of)
    thinned = own.select("doc_id", "lang").join(rows_of, "lang").where(hash_share("doc_id", ample(sample, F.col("rows")))).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = thinned.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", "lang")
    made = own.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text", "doc_id").mapInArrow(_count_batches, "lang string, idx binary, tf binary, doc_id long")
    made = made.where("idx IS NOT NULL").groupBy("doc_id", "lang").agg(F.min(F.struct("idx", "tf")).alias("x"))  # one text of an id that repeats
    rows = sorted((r.lang, bytes(r.x.idx), bytes(r.x.tf)) for r in made.collect())
    df, n = np.zeros(BUCKETS), 0
    for r in own.select("text").mapInArrow(_frequency_batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return fit([(lang, np.frombuffer(i, np.int32), np.frombuffer(c, np.int64)) for lang, i, c in rows], df, n)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), a row for each row of docs (doc_id, text, ...).

    lang_pred is the nearest learned language, also of a rejected text; it is `und` for a null text, one without letters, and
    where no language was learned. score is the cosine, 0 to 1. held_out is null where doc_id is. Rows that repeat stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lang, score, rejected = zip(*(own.nearest(t) for t in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in rejected], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.mapInArrow(find, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from docs (doc_id, text, lang) outside the held-out fold and identifies every row."""
    return identify(docs, train(docs, sample))
