"""Lexical retrieval packing: windows filled with the neighbours that a sharded BM25 index returns.

A document's ids (with the end id) fill whole windows of their own; what is left over, under a window, is packed. Shards hold
a bounded number of leftovers of like content: a tree of k-means centroids, fitted on a sample, leads a leftover to its shard,
so that most neighbours meet. Only groups that centroids can't part, as of copies, are dealt by a hash. Each shard has an
inverted index over its token ids, weighted by BM25 with document frequencies of the whole corpus. In a shard the longest unused
leftover is the seed of a window; its rarest terms are the query, and unused neighbours, best first, fill the window: those
that fit whole, then, where none of those retrieved fits, the best of the others is cut to fill it, and its rest is packed on.
Only a shard's last window is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, stored

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 1024
END = 0
#: Leftovers in a shard, about.
SHARD = 4000
#: The tree: how many times SHARD a shard may hold (by the sample), sampled leftovers for each shard, at least and at most, ways
#: of a node, its vectors' length, and rounds of k-means.
LOOSE = 1.25
EACH, LEAST, MOST = 40, 4000, 60_000
WAYS = 8
DIM = 1024
ROUNDS = 8
#: Terms of a query; K1 and B are the usual constants of BM25.
TERMS = 24
K1, B = 1.2, 0.75
#: Neighbours that are tried for a window at once, best first; the next ones only if all of them are placed.
TRIED = 64


#: Characters of a text that are encoded at once, about.
SEGMENT = 1 << 20
_SEAM = re.compile(r"[^\W\d_](?= [^\W\d_])")


class Encoder:
    """Ids as the tokenizers library gives them: the ranks of the same vocabulary, and special strings as their ids."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        for mark, id_ in self.special.items():
            if mark in text:
                out: list[int] = []
                for i, part in enumerate(text.split(mark)):
                    out += ([id_] if i else []) + self.encode(part)
                return out
        return self.own.encode_ordinary(text)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about `size` characters, or as long as it takes to a space between letters: there the pattern always ends one match and begins another, so ids don't change."""
    at = 0
    while len(text) - at > size:
        seam = _SEAM.search(text, at + size)
        if seam is None:
            break
        yield text[at : seam.start() + 1]
        at = seam.start() + 1
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    return Encoder(path, ranks, pattern)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, path: str, ranks: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, ids, nth): whole windows without ids, and a leftover of each document with them (16 bits each).

    nth tells rows apart that are equal in all else.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, ranks, pattern)
        nth = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([*(np.array(tool.encode(x), "<u4") for x in segments(text or "")), np.array([END], "<u4")])
                n = len(ids)
                nth += 1
                for at in range(0, n, window):
                    piece = ids[at : at + window]
                    rows.append((doc_id, at, len(piece), crc(piece), n, piece.astype("<u2").tobytes() if len(piece) < window else None, nth))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, nth long")


def frequencies(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """(leftovers with each id, leftovers, their mean length) over the whole corpus; ids are 16 bits, so the table is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                df[distinct(np.frombuffer(ids, "<u2"))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["id", "df"])

    left = pieces.where("ids IS NOT NULL")
    df = np.zeros(1 << 16, np.int64)
    for r in left.select("ids").mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r["id"]] = r["df"]
    found = left.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return df, found["n"], found["mean"] or 1.0


def distinct(ids: np.ndarray) -> np.ndarray:
    """Each id once, ascending."""
    ids = np.sort(ids)
    keep = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=keep[1:])
    return ids[keep]


class Index:
    """A shard's inverted index: postings by id, and BM25 weights of each posting."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(x) for x in items])
        key = np.concatenate(items).astype(np.int64) * len(items) + np.repeat(np.arange(len(items)), lengths)
        pairs, tf = np.unique(key, return_counts=True)
        self.term, self.doc = pairs // len(items), (pairs % len(items)).astype(np.int32)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean))
        self.starts = np.searchsorted(self.term, np.arange((1 << 16) + 1))
        order = np.lexsort((-self.weight, self.doc))
        first = np.searchsorted(self.doc[order], np.arange(len(items)))
        self.query = [self.term[order[first[i] : (first[i + 1] if i + 1 < len(items) else len(order))][:TERMS]] for i in range(len(items))]
        self.first, self.last = ([self.starts[q + i].tolist() for q in self.query] for i in (0, 1))
        self.n = len(items)

    def neighbours(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores) that share a query term with the seed."""
        spans = list(zip(self.first[seed], self.last[seed], strict=True))
        score = np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), self.n)
        near = np.flatnonzero(score)
        return near, score[near]


def fill(items: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of every piece; items are shorter than the window."""
    if not items:
        return []
    index = Index(items, idf, mean)
    size = np.array([len(x) for x in items])
    done = np.zeros(len(items), np.int64)  # ids of an item that are placed
    order = np.argsort(-size, kind="stable")
    out: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0

    def place(i: int, most: int) -> None:
        nonlocal offset
        n = int(min(size[i] - done[i], most))
        out.append((int(i), int(done[i]), n, sequence, offset))
        done[i] += n
        offset += n

    cut: int | None = None  # an item of which a part is placed seeds the next window
    cursor = 0
    while True:
        while cursor < len(order) and done[order[cursor]] >= size[order[cursor]]:
            cursor += 1
        if cut is None and cursor == len(order):
            return out
        seed = order[cursor] if cut is None else cut
        cut = None
        place(seed, window)
        near, score = index.neighbours(seed)
        open_ = done[near] < size[near]
        near, score = near[open_], score[open_]
        if len(near) > TRIED:
            top = np.argpartition(-score, TRIED)[:TRIED]
            ranked = top[np.lexsort((near[top], -score[top]))]
        else:
            ranked = np.lexsort((near, -score))
        tried = 0
        while True:
            some = near[ranked[tried : tried + TRIED]].tolist()
            for i in some:
                if size[i] - done[i] <= window - offset:
                    place(i, window)
            tried += TRIED
            if offset == window or tried >= len(near) or any(done[i] < size[i] for i in some):
                break
            if len(ranked) < len(near):  # all of the best are placed: on through those that come next
                rest = np.setdiff1d(np.arange(len(near)), ranked)
                ranked = np.concatenate([ranked, rest[np.lexsort((near[rest], -score[rest]))]])
        near = some
        spare = cursor
        while offset < window:  # none of them fits whole: the best of the rest is cut
            i = next((i for i in near if done[i] < size[i]), None)
            if i is None:
                while spare < len(order) and done[order[spare]] >= size[order[spare]]:
                    spare += 1
                if spare == len(order):
                    break
                i = order[spare]
            place(i, window - offset)
            if done[i] < size[i]:
                cut = i
        sequence, offset = sequence + 1, 0


def vectors(items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of the items' rarest terms: idf by hashed id, each id once."""
    key = np.concatenate([distinct(x).astype(np.int64) + (i << 16) for i, x in enumerate(items)])
    id_ = key & 0xFFFF
    lane = (id_ * 40503 & 0xFFFF) * DIM >> 16
    x = np.bincount((key >> 16) * DIM + lane, idf[id_] ** 2, len(items) * DIM).reshape(len(items), DIM).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Tree:
    """Centroids by which leftovers are led to shards.

    Small leaves that follow each other share a shard; a leaf that no centroid parts has several, dealt by a hash.
    """

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, share: float, shard: int, seed: int = 7):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # centroids, and of each: a node, or a leaf as -1 - leaf
        self.expected: list[float] = []  # leftovers of each leaf
        self.idf, self.rng = idf, np.random.default_rng(seed)
        x = np.concatenate([vectors(items[i : i + 1000], idf) for i in range(0, len(items), 1000)]) if items else np.zeros((0, DIM), np.float32)
        self.root = self._grow(x, share, shard)
        # of each leaf: its first shard, and how many it has
        self.base, self.parts = np.zeros((2, len(self.expected)), np.int64)
        self.count, held = 0, np.inf
        for leaf, n in enumerate(self.expected):
            self.parts[leaf] = max(1, np.ceil(n / shard / LOOSE))
            if held + n > shard * LOOSE:
                self.count, held = self.count + int(self.parts[leaf]), 0.0
            held = held + n if self.parts[leaf] == 1 else np.inf
            self.base[leaf] = self.count - self.parts[leaf]

    def _grow(self, x: np.ndarray, share: float, shard: int) -> int:
        expected = len(x) / share
        if expected > shard * LOOSE:
            centre, near = self._parted(x, int(min(WAYS, max(2, round(expected / shard)))))
            if len(centre) > 1:
                at = len(self.nodes)
                self.nodes.append((centre, []))
                self.nodes[at][1].extend([self._grow(x[near == i], share, shard) for i in range(len(centre))])
                return at
        self.expected.append(expected)
        return -len(self.expected)

    def _parted(self, x: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
        centre = np.unique(x[self.rng.choice(len(x), ways, replace=False)], axis=0)
        for _ in range(ROUNDS):
            near = np.argmax(x @ centre.T, axis=1)
            there = np.unique(near)
            centre = np.stack([x[near == i].mean(axis=0) for i in there])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ centre.T, axis=1)
        there, near = np.unique(near, return_inverse=True)
        return centre[there], near

    def shards(self, items: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The shard of each item."""
        x = vectors(items, self.idf)
        leaf = np.zeros(len(items), np.int64)
        stack = [(self.root, np.arange(len(items)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            centre, below = self.nodes[node]
            near = np.argmax(x[rows] @ centre.T, axis=1)
            stack += [(to, rows[near == i]) for i, to in enumerate(below) if (near == i).any()]
        return self.base[leaf] + hashes % self.parts[leaf]


def grown(pieces: DataFrame, idf: np.ndarray, n: int, shard: int) -> Tree:
    """The tree of a sample of leftovers, those with the least hash; nth tells equal rows apart, so that as many of them are in it as of others."""
    share = min(1.0, min(MOST, max(LEAST, EACH * (n // shard + 1))) / max(1, n))
    own = pieces.where("ids IS NOT NULL")
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id", "ids_crc32", "nth"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted(bytes(r.ids) for r in own.select("ids").collect())
    return Tree([np.frombuffer(x, "<u2") for x in found], idf, share, shard)


def packed(docs: DataFrame, path: str, ranks: str, pattern: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A null or empty text has the end id only. Rows that repeat are packed each for itself. A null doc_id stays null. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stored(encoded(docs, path, ranks, pattern, window))
    df, n, mean = frequencies(pieces)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    tree = spark.sparkContext.broadcast(grown(pieces, idf.value, n, shard))

    @F.pandas_udf("long")
    def led(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), 500):
            out[at : at + 500] = tree.value.shards([np.frombuffer(x, "<u2") for x in ids.iloc[at : at + 500]], hashes.to_numpy()[at : at + 500])
        return pd.Series(out)

    # the sample takes the hash's low bits, so others deal here; nth deals rows that are equal
    left = pieces.where("ids IS NOT NULL")
    own = left.withColumn("shard", led("ids", F.shiftrightunsigned(F.xxhash64("doc_id", "ids_crc32", "nth"), 31)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        base = int(rows["shard"].iloc[0]) << 32
        items = [np.frombuffer(x, "<u2") for x in rows["ids"]]
        out = pd.DataFrame(fill(items, idf.value, mean, window), columns=["item", "at", "length", "sequence_id", "offset"])
        out["ids_crc32"] = [crc(items[i][a : a + n]) for i, a, n in zip(out["item"], out["at"], out["length"], strict=True)]
        of = rows.iloc[out["item"]]
        out["doc_id"], out["start"], out["doc_tokens"] = of["doc_id"].array, of["start"].array + out["at"].array, of["doc_tokens"].array
        out["sequence_id"] += base
        return out[names]

    filled = own.groupBy("shard").applyInPandas(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # whole windows are sequences as they stand; the stored table gives each row the same number whenever it's read
    whole = pieces.where("ids IS NULL").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return filled.unionByName(whole.select(*names))
