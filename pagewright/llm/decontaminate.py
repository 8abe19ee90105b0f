"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items.

The CGK embedding walks over a string: at each of its steps it writes the current character, and a random function of the
step and the character says whether the walk moves on. Strings at edit distance k get embeddings at Hamming distance
O(k^2), mostly O(k), as two walks meet again soon after an edit. Here the walk is the hash: a key samples some coordinates
of the walk from a place, and REPEATS walks with other random functions make REPEATS tables.

A walk passes over about half as many characters as it has steps, so that at a fifth of edits some walks of a passage still
agree with the item's. They start at every character of items and every few of documents, and not at words, as there are texts
without spaces. Places whose first PREFIXES coordinates no item has are given up. What
remains votes for the place where the item would start. Where an item has as many votes as needed() says, within the shift
that its budget of edits allows, it is verified by the exact edit distance between it and the best passage there.

Items too short for walks are cut into one piece more than they may have edits, so one piece is in any passage as it is: every
place of a piece is verified. Their passages are whole words, as many as the item's; in scripts without spaces they are any.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

SIMILARITY = 0.8
REPEATS = 6
#: Every so many characters of a document a walk starts (at every one of an item).
STRIDE = 3
#: Classes of characters, steps of a walk for each coordinate of its key, and after how many coordinates places are given up.
CLASSES = 32
THIN = 3
PREFIXES = (5, 7, 9)
#: Least length of an item and coordinates of its keys: short items need short walks, long ones bear keys that chance seldom meets.
LENGTHS = ((80, 12), (48, 11))
SHORT = min(least for least, _ in LENGTHS)
#: Items in a block that is broadcast, by characters at most; more items make more blocks, each against all documents.
BLOCK_CHARS = 1 << 20
#: Places handled at once, votes at once, and characters of texts searched together.
CHUNK = 1 << 16
VOTES = 1 << 20
TOGETHER = 1 << 19
#: Leading bits of a key by which a filter tells whether an item may have it.
FILTER = 20
SEED = 11

_WORD = re.compile(r"\w+")
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters: words aren't told apart by spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Characters of a piece of a short item at most, 8 bits each.
PIECE = 7


def normal(text: str | None) -> str:
    """Lower case, white space collapsed."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    """A number under 256 for each character (its code point, folded)."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((x ^ (x >> 8) ^ (x >> 16)) & 255).astype(np.int64)


def triples(text: str, more: int = 0) -> np.ndarray:
    """For each character, and `more` empty ones after the text, the classes of it and the next two in one number."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.zeros(len(x) + more + 2, np.int64)
    c[: len(x)] = (x ^ (x >> 5) ^ (x >> 10) ^ (x >> 15)) & (CLASSES - 1)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def bucket(key: np.ndarray) -> np.ndarray:
    """A number of FILTER bits for each key."""
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER)).view(np.int64)


class Walks:
    """REPEATS random walks; the same on every machine.

    One of every THIN steps is sampled. Such a block of steps depends on THIN characters only, so it is a table: for each three
    classes of characters, the class that is sampled and how far the walk gets.
    """

    def __init__(self, sampled: int, repeats: int = REPEATS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.sampled, self.repeats, self.steps = sampled, repeats, sampled * THIN
        move = rng.integers(0, 2, (repeats, sampled, THIN, CLASSES))
        taken = rng.integers(0, THIN, (repeats, sampled))
        three = np.arange(CLASSES**THIN)
        chars = np.stack([three // CLASSES ** (THIN - 1 - i) % CLASSES for i in range(THIN)])
        self.blocks = np.zeros((repeats, sampled, len(three)), np.uint8)
        for r, n in np.ndindex(repeats, sampled):
            at = np.zeros(len(three), np.int64)
            for step in range(THIN):
                c = chars[at, three]
                if step == taken[r, n]:
                    self.blocks[r, n] = c
                at += move[r, n, step][c]
            self.blocks[r, n] += (at * CLASSES).astype(np.uint8)

    def keys(self, text: np.ndarray, at: np.ndarray, repeat: int, known: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(places, keys, keys after each of PREFIXES coordinates) of the walks from `at`; text (triples) goes on for steps + 1 empty ones.

        With `known`, filters of those prefixes of the items: only the places whose prefixes pass them all. Without, only the
        places from which the walk stays within the text.
        """
        place, key, here = at, np.zeros(len(at), np.int64), at
        levels = []
        for n in range(self.sampled):
            block = self.blocks[repeat, n].take(text.take(here))
            key = key * CLASSES + (block & (CLASSES - 1))
            here = here + (block // CLASSES)
            if n + 1 in PREFIXES:
                if known is None:
                    levels.append(key)
                else:
                    keep = np.flatnonzero(known[PREFIXES.index(n + 1)].take(bucket(key)))
                    place, key, here = place.take(keep), key.take(keep), here.take(keep)
                    if not len(place):
                        break
        if known is None:
            keep = here <= len(text) - self.steps - 1
            place, key, levels = place[keep], key[keep], [x[keep] for x in levels]
        return place, key, levels


@dataclass
class Table:
    walks: Walks
    known: list[list[np.ndarray]]  # of each repeat: filters of the keys after each of PREFIXES coordinates
    posts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each repeat: keys, ascending, and item and offset of each


class Short:
    """Short items by pieces; an item without the punctuation at its ends, if it has words."""

    def __init__(self, texts: list[str], own: list[int], similarity: float):
        self.item: dict[int, str] = {}
        self.words: dict[int, int] = {}  # 0: passages need not be whole words
        pieces: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for n in own:
            item = texts[n]
            spans = [] if _UNSPACED.search(item) else [m.span() for m in _WORD.finditer(item)]
            if spans:
                item = item[spans[0][0] : spans[-1][1]]
            self.item[n], self.words[n] = item, len(spans)
            most = budget(item, similarity)
            size = min(PIECE, len(item) // (most + 1))
            for x in range(most + 1):
                at = x * len(item) // (most + 1)
                before = sum(a - spans[0][0] <= at for a, _ in spans) - 1
                pieces[size].append((int(packed(codes(item[at : at + size]), size)[0]), n, at, before))
        self.similarity = similarity
        self.pieces = {size: np.array(sorted(rows), np.int64).T for size, rows in pieces.items()}

    def hits(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each normalised text, items and (distance, end) of their nearest, then first, passages."""
        joined = "\n".join(texts)
        chars = codes(joined)
        lengths = np.array([len(t) for t in texts]) + 1
        ends = np.cumsum(lengths)
        spans = np.array([m.span() for m in _WORD.finditer(joined)] if any(self.words.values()) else [], np.int64).reshape(-1, 2)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]

        def found(d: int, n: int, distance: int, end: int) -> None:
            end -= int(ends[d] - lengths[d])
            if n not in out[d] or (distance, end) < out[d][n]:
                out[d][n] = (distance, end)

        for size, (keys, items, offsets, before) in self.pieces.items():
            text_keys = packed(chars, size)
            first = np.searchsorted(keys, text_keys)
            there = np.flatnonzero(keys.take(np.minimum(first, len(keys) - 1)) == text_keys)
            many = np.searchsorted(keys, text_keys[there], side="right") - first[there]
            post = np.arange(many.sum()) + np.repeat(first[there] - np.cumsum(many) + many, many)
            place = np.repeat(there, many)
            for n in np.unique(items[post]).tolist():
                own = items[post] == n
                self._verify(n, place[own], offsets[post[own]], before[post[own]], joined, spans, ends, found)
        return out

    def _verify(self, n: int, place: np.ndarray, offset: np.ndarray, before: np.ndarray, joined: str, spans: np.ndarray, ends: np.ndarray, found) -> None:
        item, words = self.item[n], self.words[n]
        most = budget(item, self.similarity)
        if not words:
            for start in np.unique(place - offset).tolist():
                at = int(np.searchsorted(ends, max(0, start), side="right"))
                for d in {at, min(at + 1, len(ends) - 1)}:  # the first characters may be missing at the start of a text
                    lo = max(0, start - most, int(ends[d - 1]) if d else 0)
                    hi = min(start + len(item) + most, int(ends[d]) - 1)
                    if lo < hi:
                        distance, end = infix_distance(item, joined[lo:hi])
                        if distance <= most:
                            found(d, n, distance, lo + end)
            return
        word = np.searchsorted(spans[:, 0], place, side="right") - 1 - before
        first = np.unique(np.concatenate([word + shift for shift in range(-(most // 2), most // 2 + 1)]))
        first = first[(first >= 0) & (first + words <= len(spans))]
        lo, hi = spans[first, 0], spans[first + words - 1, 1]
        near = (abs(hi - lo - len(item)) <= most) & (np.searchsorted(ends, lo, side="right") == np.searchsorted(ends, hi - 1, side="right"))
        for a, b in zip(lo[near].tolist(), hi[near].tolist(), strict=True):
            distance = whole_distance(item, joined[a:b])
            if distance <= most:
                found(int(np.searchsorted(ends, a, side="right")), n, distance, b)


def packed(chars: np.ndarray, size: int) -> np.ndarray:
    """Every `size` characters that follow each other as one number."""
    n = max(0, len(chars) - size + 1)
    out = np.zeros(n, np.int64)
    for i in range(size):
        out = out << 8 | chars[i : i + n]
    return out


@dataclass
class Index:
    ids: list[int]
    texts: list[str]
    tables: list[Table]  # of the items of each of LENGTHS, where there are any
    shift: np.ndarray  # of each item: the edits that it may have
    needed: np.ndarray  # of each item: votes that it is verified for
    short: Short | None  # items too short for a walk, where there are any


def needed(length: int) -> int:
    """Votes for which an item is verified. Random passages with a fifth of edits nearly all have as many; tests hold recall to 0.9."""
    if length < LENGTHS[0][0]:
        return max(1, (length - 65) // 7)
    return max(1, (length - 70) // 11, (length - 110) // 7)


def build(items: list[tuple[int, str]], similarity: float = SIMILARITY) -> Index:
    ids, texts = [i for i, _ in items], [t for _, t in items]
    short: list[int] = []
    dealt: list[list[int]] = [[] for _ in LENGTHS]
    for n, text in enumerate(texts):
        own = next((x for x, (least, _) in zip(dealt, LENGTHS, strict=True) if len(text) >= least), None)
        if own is None:
            short.append(n)
        else:
            own.append(n)
    tables = [_table(texts, own, Walks(sampled)) for own, (_, sampled) in zip(dealt, LENGTHS, strict=True) if own]
    most = np.array([budget(t, similarity) for t in texts], np.int64)
    return Index(ids, texts, tables, most, np.array([needed(len(t)) for t in texts], np.int64), Short(texts, short, similarity) if short else None)


def _table(texts: list[str], own: list[int], walks: Walks) -> Table:
    known, posts = [], []
    coded = [triples(texts[n], walks.steps + 1) for n in own]
    for r in range(walks.repeats):
        filters = [np.zeros(1 << FILTER, bool) for _ in PREFIXES]
        found = []
        for n, chars in zip(own, coded, strict=True):
            place, key, prefixes = walks.keys(chars, np.arange(len(texts[n])), r, None)
            for bits, prefix in zip(filters, prefixes, strict=True):
                bits[bucket(prefix)] = True
            found.append((key, np.full(len(key), n, np.int32), place.astype(np.int32)))
        key, item, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        known.append(filters)
        posts.append((key[order], item[order], offset[order]))
    return Table(walks, known, posts)


def infix_distance(item: str, text: str) -> tuple[int, int]:
    """(least edit distance of item to any passage of text, where that passage ends), bit-parallel."""
    m = len(item)
    if not m:
        return 0, 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, eq in enumerate([peq.get(c, 0) for c in text]):
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return best, end


def whole_distance(a: str, b: str) -> int:
    """Edit distance of short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def budget(item: str, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * len(item) + 1e-9)


def votes(text: np.ndarray, n: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item << 32 | place where it would start, ascending, how many walks say so) for the first n of text (triples); places are moved on by 2**31."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for table, r in ((t, r) for t in index.tables for r in range(t.walks.repeats)):
        keys, items, offsets = table.posts[r]
        for lo in range(0, n, CHUNK):
            place, key, _ = table.walks.keys(text, np.arange(lo, min(n, lo + CHUNK), STRIDE), r, table.known[r])
            first = np.searchsorted(keys, key)
            many = np.searchsorted(keys, key, side="right") - first
            upto = np.cumsum(many)
            at = 0
            while at < len(many) and upto[-1]:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VOTES, side="right")))
                some = many[at:to]
                post = np.arange(some.sum()) + np.repeat(first[at:to] - np.cumsum(some) + some, some)
                start = np.repeat(place[at:to], some) - offsets[post] + (1 << 31)
                found.append(np.unique(items[post].astype(np.int64) << 32 | start, return_counts=True))
                at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = (np.concatenate(x) for x in zip(*found, strict=True))
    key, same = np.unique(key, return_inverse=True)
    return key, np.bincount(same, count, len(key)).astype(np.int64)


def candidates(texts: list[str], index: Index) -> list[list[tuple[int, int, int]]]:
    """For each normalised text, (item, first and last place where it would start) with as many votes as are needed, ascending."""
    lengths = np.array([len(t) for t in texts]) + 1
    ends = np.cumsum(lengths)
    text = triples("\n".join(texts), max((t.walks.steps for t in index.tables), default=0) + 2)
    key, count = votes(text, int(ends[-1]) - 1, index)
    item = key >> 32
    total = np.concatenate([[0], np.cumsum(count)])
    enough = total[np.searchsorted(key, key + index.shift[item], side="right")] - total[:-1] >= index.needed[item]
    key, item = key[enough], item[enough]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(key):
        return out
    cut = np.flatnonzero(np.diff(key) > index.shift[item[1:]]) + 1
    for lo, hi in zip([0, *cut.tolist()], [*(cut - 1).tolist(), len(key) - 1], strict=True):
        n = int(item[lo])
        most = int(index.shift[n])
        first, last = (int(key[x] & 0xFFFFFFFF) - (1 << 31) for x in (lo, hi))
        last += most
        # the passage may lie in any text that the window touches
        d = int(np.searchsorted(ends, max(0, first - most), side="right"))
        while d < len(texts) and ends[d] - lengths[d] < last + len(index.texts[n]) + most:
            begin = int(ends[d] - lengths[d])
            out[d].append((n, first - begin, last - begin))
            d += 1
    return out


def find_all(texts: list[str | None], index: Index, similarity: float = SIMILARITY) -> list[list[tuple[int, int, int]]]:
    """verified() of each text, and its short items; texts being searched together up to TOGETHER characters."""
    out: list[list[tuple[int, int, int]]] = []
    some: list[str] = []
    size = 0
    for t in [*texts, None]:
        if len(out) + len(some) < len(texts):
            some.append(normal(t))
            size += len(some[-1])
            if size < TOGETHER:
                continue
        if some:
            more = index.short.hits(some) if index.short else [{}] * len(some)
            out += [
                sorted([*verified(text, places, index, similarity), *((index.ids[n], *hit) for n, hit in short.items())])
                for text, places, short in zip(some, candidates(some, index), more, strict=True)
            ]
        some, size = [], 0
    return out


def verified(text: str, places: list[tuple[int, int, int]], index: Index, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(item_id, distance, end) of the items that have a passage in the normalised text within the budget; the nearest, then first, of each."""
    best: dict[int, tuple[int, int]] = {}
    for n, first, last in places:
        item = index.texts[n]
        most = budget(item, similarity)
        lo, hi = max(0, first - most), last + len(item) + most
        passage = text[lo:hi]
        if len(passage) < len(item) - most or n in best and best[n][0] == 0:
            continue
        where = passage.find(item)
        distance, end = (0, where + len(item)) if where >= 0 else infix_distance(item, passage)
        if distance <= most and (n not in best or (distance, lo + end) < best[n]):
            best[n] = (distance, lo + end)
    return sorted((index.ids[n], *best[n]) for n in best)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Blocks of normalised items of bounded size; null and empty texts, and null ids, are no items; repeated rows count once."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = own.where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for row in own.toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end_char), a row for each item that a row of docs has a passage of.

    distance is the edit distance between the normalised item and the nearest passage of the normalised text (lower case,
    white space collapsed), at most 1 - similarity of the item's length; end_char is where the first such passage ends. Passages
    of items under SHORT characters are whole words, as many as the item's, and punctuation at an item's ends doesn't count. Null and empty texts have no passage. Rows that
    repeat give their rows again; an empty table on either side gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, end_char long"
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(benchmark, block_chars)):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = tools(tuple(shared.value), similarity)
            for batch in batches:
                found = find_all(batch.column(1).to_pylist(), index, similarity)
                rows = [(d, *hit) for d, hits in zip(batch.column(0).to_pylist(), found, strict=True) for hit in hits]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "distance", "end_char"])

        found = own.mapInArrow(search, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without a passage of any item, with the columns of docs. Rows whose doc_id is null are judged, too."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for block in item_blocks(benchmark):
        docs = docs.where(~_hit(spark.sparkContext.broadcast(block), similarity)(F.col("text").cast("string")))
    return docs


def _hit(shared, similarity: float):
    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = tools(tuple(shared.value), similarity)
        for texts in parts:
            yield pd.Series([bool(hits) for hits in find_all(texts.tolist(), index, similarity)])

    return hit


@lru_cache(maxsize=4)
def tools(block: tuple[tuple[int, str], ...], similarity: float = SIMILARITY) -> Index:
    """The index of a block, built once in a worker."""
    return build(list(block), similarity)
