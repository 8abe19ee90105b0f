"""Importance resampling: documents are drawn by how much likelier their n-grams are in a target corpus than in the corpus at large.

An n-gram's bucket is the CRC-32 of its words joined by spaces. CRCs form an algebra: crc(a + b) is crc(a), moved on by len(b)
zero bytes, xor crc(b); moving on is a linear map over GF(2), so the map for any length is composed of those for powers of two.
Each word's CRC is computed once, and those of all longer n-grams are composed of it; no n-gram's string is ever made.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, stored

#: Fixed values of the query: longest n-gram, buckets, least words of a document that may be drawn, percent drawn, seed.
MAX_N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: The polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320
#: Words as bytes of lower-cased UTF-8: what isn't ASCII counts as a letter.
WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: A text's words are listed by segments of about so many bytes, so that a very long one takes no more memory.
SEGMENT = 1 << 20


@functools.cache
def zero_byte_maps(powers: int = 48) -> np.ndarray:
    """maps[p, k, v]: the byte v at place k of a CRC after 2**p zero bytes. A map of a CRC is the xor of its four bytes' maps."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1)
    one = np.empty((4, 256), np.uint32)
    for k in range(4):
        v = np.arange(256, dtype=np.uint32) << (8 * k)
        one[k] = (v >> 8) ^ x[v & 255]
    out = np.empty((powers, 4, 256), np.uint32)
    out[0] = one
    for p in range(1, powers):
        out[p] = moved(out[p - 1], out[p - 1])
    return out


def moved(of: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs under one map."""
    return of[0][crc & 255] ^ of[1][(crc >> 8) & 255] ^ of[2][(crc >> 16) & 255] ^ of[3][crc >> 24]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by length zero bytes each."""
    crc, maps = crc.astype(np.uint32), zero_byte_maps()
    for p in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> p) & 1)
        crc[at] = moved(maps[p], crc[at])
    return crc


def combined(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """The CRCs of strings a + b from those of a and of b."""
    return shifted(a, b_length) ^ b


def ngrams(words: np.ndarray, lengths: np.ndarray, max_n: int, fresh: int = 0) -> Iterator[np.ndarray]:
    """For each n up to max_n the CRCs of the n-grams of a text, from its words' CRCs and lengths; those only that end at word `fresh` or later."""
    yield words[fresh:]
    if max_n > 1 and len(words) > 1:
        spaced = combined(np.full(len(words), zlib.crc32(b" "), np.uint32), words, lengths)  # of " " + word
        grams = words
        for n in range(2, min(max_n, len(words)) + 1):
            grams = combined(grams[:-1], spaced[n - 1 :], lengths[n - 1 :] + 1)
            yield grams[max(0, fresh - n + 1) :]


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """text cut between words about every size bytes."""
    at = 0
    while at < len(text):
        found = BREAK.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def features(text: bytes, max_n: int, size: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, CRCs of their n-grams) of a text, by segments; n-grams reach over segments."""
    crcs, lengths = np.empty(0, np.uint32), np.empty(0, np.int64)
    for part in segments(text.lower(), size):
        words = WORD.findall(part)
        fresh = len(crcs)
        crcs = np.concatenate([crcs, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])
        if max_n > 1:
            lengths = np.concatenate([lengths, np.fromiter(map(len, words), np.int64, len(words))])
        yield len(words), np.concatenate(list(ngrams(crcs, lengths, max_n, fresh)))
        keep = max_n - 1
        crcs, lengths = crcs[len(crcs) - min(keep, len(crcs)) :], lengths[len(lengths) - min(keep, len(lengths)) :]


def bucket_counts(rows: DataFrame, text: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; a task sends on one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                for _, crcs in features(value.as_py() or b"", max_n):
                    total += np.bincount(crcs % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    bounded_batches(rows.sparkSession)
    return rows.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in target than in docs, one added to every count; 0 where docs have none.

    What comes to the driver is two numbers a bucket at most.
    """
    s = dict(map(tuple, bucket_counts(docs, "text", max_n, buckets).collect()))
    t = dict(map(tuple, bucket_counts(target, "text", max_n, buckets).collect()))
    s_all, t_all = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    out = np.zeros(buckets, np.int64)
    for bucket, n in s.items():
        out[bucket] = math.floor(1000 * math.log((t.get(bucket, 0) + 1) * s_all / ((n + 1) * t_all)))
    return out


def weighed(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: weight is the sum of its features' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(batch.column(1).cast(pa.binary())):
                for n, crcs in features(value.as_py() or b"", max_n):
                    found[:, i] += n, len(crcs), gain[crcs % len(gain)].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found)], ["doc_id", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the hash of seed and doc_id: the highest of weight + noise are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """rows with `rank`: the place by score, then doc_id, of the highest floor(percent/100 * rows that may be drawn); null for the others.

    Rows are sorted by ranges over all tasks and written so; a row's rank is its place in its range after the lengths of the
    ranges before, of which one number each comes to the driver.
    """
    may = F.col("n_words") >= least_words
    order = [F.when(may, 0).otherwise(1).asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_nth")]  # equal rows are dealt by _nth
    # stored before, as the ranges are laid out from a sample, for which all would be weighed once more
    ranged = stored(rows).withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = sorted(map(tuple, ranged.groupBy("_range").agg(F.count("*"), F.count_if(may)).collect()))
    before, starts = 0, []
    for part, n, _ in counts:
        starts.append((part, before))
        before += n
    drawn = percent * sum(c[2] for c in counts) // 100
    start = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    place = F.col("_start") + F.col("_at") + 1
    return ranged.join(F.broadcast(start), "_range").withColumn("rank", F.when(place <= drawn, place)).drop("_nth", "_range", "_at", "_start")


def resampled(
    docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), all long, of every row of docs (doc_id, text); target: (text).

    A null or empty text has no words, so weight 0, and is never drawn while least_words is over 0. Rows of one doc_id and
    text tie, and take ranks one after another; a null doc_id hashes as an empty one and comes last among ties. With no
    target rows, or no words in them, what is rare in docs is likelier. Other columns are ignored.
    """
    rows = weighed(docs, gains(docs, target, max_n, buckets), max_n)
    return ranked(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), least_words, percent)


def _nibbles() -> list[int]:
    """The CRCs of half bytes."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        out.append(x)
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""WITH texts AS (SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT target, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT target, r, unnest(w) AS word FROM words),
counts AS (SELECT target, r, word, count(*) AS c FROM features GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM counts),
halves AS (SELECT word, flatten([[instr('0123456789ABCDEF', h[2 * i + 2]) - 1, instr('0123456789ABCDEF', h[2 * i + 1]) - 1] FOR i IN range(length(h) // 2)]) AS x FROM vocabulary),
buckets AS (SELECT word, xor(list_reduce(x, LAMBDA c, y: xor(c >> 4, ({_nibbles()}::BIGINT[])[(xor(c, y) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM halves),
sums AS (SELECT bucket, coalesce(sum(c) FILTER (target = 0), 0) AS s, coalesce(sum(c) FILTER (target = 1), 0) AS t FROM counts JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS weight FROM counts JOIN buckets USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE target = 0),
places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM places"""
