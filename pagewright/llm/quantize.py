"""Compression of vectors to codes: a codebook for each part of a vector, fitted by Lloyd's algorithm with heaps of bounds.

Vectors are dealt into blocks as they are read. A block keeps, for each entry of a codebook, a heap of the parts that belong to
the entry, keyed by how much nearer the entry is than any other (lower bound minus upper bound). When entries move, a key loses
at most what its own entry and the furthest mover of the others have moved; this drift is summed up once an entry, so keys stay
as they are, and a part is popped and scanned again, exactly, only when the drift of its entry has reached its key. A block
stays in one row of a table in the shared folder, rewritten in each round, so a lost executor costs that round's work only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, stored

#: Fixed values of the query: parts of a vector, entries of a codebook, rounds, steps of one unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this, so that sums of squares stay exact: vectors of up to 65,536 a component are unaffected.
MOST = 1 << 26
#: Below this, whole numbers are exact in floating point, products of matrices included.
EXACT = 1 << 20
#: Rounding of bounds is no more than this share of them; keys are lessened by it.
SLACK = 1e-9
#: Labels of at least this share of the rows are joined by broadcast, the others by a shuffle.
HOT_SHARE = 1000
_BLOCK = "vec_id array<long>, label array<long>, kind string, x binary, entry binary, keys binary, members binary, moved binary"


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x array<double>) of vectors without null, infinite or undefined components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x")).where(x.isNotNull() & fine)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of all rows of x to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    out = np.empty((len(x), len(book)), np.int64)
    for i in range(0, len(x), 64):
        out[i : i + 64] = ((x[i : i + 64, None, :] - book[None]) ** 2).sum(2)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, of ties the first; how much further, at least, the next one is) of each row."""
    d = distances(x, book)
    entry = d.argmin(1)
    rows = np.arange(len(x))
    least = d[rows, entry].astype(np.float64)
    if d.shape[1] == 1:
        return entry, np.full(len(x), np.inf)
    d = d.astype(np.float64)
    d[rows, entry] = np.inf
    upper, lower = np.sqrt(least), np.sqrt(d.min(1))
    return entry, lower - upper - SLACK * (1 + lower + upper)


class Heaps:
    """The parts of one position in a block: a heap for each entry, one after another in `members`, with their keys."""

    def __init__(self, size: int, entries: int):
        self.entry = np.full(size, -1, np.int16)
        self.keys, self.members = np.empty(0, np.float32), np.empty(0, np.int32)
        self.entries = entries

    def heaps(self) -> dict[int, list[tuple[float, int]]]:
        """Heaps by entry, those that have members."""
        owner = self.entry[self.members]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        rows = zip(np.split(self.keys, cuts), np.split(self.members, cuts))
        return {int(self.entry[m[0]]): (k, m) for k, m in rows if len(m)}

    def popped(self, heaps: dict, drift: np.ndarray) -> list[int]:
        """The parts whose key the drift of their entry has reached, taken off their heaps; heaps whose root holds aren't opened."""
        out = []
        for entry, held in heaps.items():
            if isinstance(held, tuple) and held[0][0] > drift[entry]:
                continue
            heap = heaps[entry] = opened(held)
            while heap and heap[0][0] <= drift[entry]:
                out.append(heappop(heap)[1])
        return out

    def step(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Assigns again what must be looked at; returns the rows looked at."""
        reached = drift * (1 + SLACK)
        heaps = self.heaps()
        first = not len(self.members)
        rows = np.arange(len(x)) if first else np.array(self.popped(heaps, reached), np.int64)
        if not len(rows):
            return rows
        found, margin = nearest(x[rows], book)
        self.entry[rows] = found
        keys = np.nextafter((margin + drift[found]).astype(np.float32), np.float32(-np.inf))
        for i, entry, key in zip(rows.tolist(), found.tolist(), keys.tolist()):
            if first:
                heaps.setdefault(entry, []).append((key, i))
            else:
                heap = heaps[entry] = opened(heaps.get(entry, []))
                heappush(heap, (key, i))
        if first:
            for heap in heaps.values():
                heapify(heap)
        closed = [h if isinstance(h, tuple) else (np.array([k for k, _ in h], np.float32), np.array([i for _, i in h], np.int32)) for h in heaps.values()]
        self.keys, self.members = np.concatenate([k for k, _ in closed]), np.concatenate([m for _, m in closed])
        return rows


def opened(held) -> list[tuple[float, int]]:
    return held if isinstance(held, list) else list(zip(held[0].tolist(), held[1].tolist()))


def narrow(x: np.ndarray) -> np.ndarray:
    """x in two bytes where that holds it, else in four."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4")


def assigned(blocks: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """The blocks with every part at its nearest entry.

    Each task adds one row, which has only `moved`: the change of the sums and counts of all entries. In the first round the
    rows are (vec_id, label, x) instead, and become blocks here.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for ids, labels, x, heaps in new_blocks(batch, books) if first else stored_blocks(batch, books):
                for p, held in enumerate(heaps):
                    own, before = x[:, p * width : (p + 1) * width], held.entry.copy()
                    rows = held.step(own, books[p], drift[p])
                    rows = rows[before[rows] != held.entry[rows]]
                    counted = np.column_stack([own[rows], np.ones(len(rows), np.int64)])
                    np.add.at(moved[p], held.entry[rows], counted)
                    if not first:
                        np.subtract.at(moved[p], before[rows], counted)
                joined = [b"".join(np.ascontiguousarray(getattr(h, c)).tobytes() for h in heaps) for c in ("entry", "keys", "members")]
                narrowed = narrow(x)
                yield row(ids, labels, narrowed.dtype.str, narrowed.tobytes(), *joined, None)
        yield row(None, None, None, None, None, None, None, moved.tobytes())

    return blocks.mapInArrow(run, _BLOCK)


_TYPES = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), *[pa.binary()] * 5)
_NAMES = ["vec_id", "label", "kind", "x", "entry", "keys", "members", "moved"]


def row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)


def new_blocks(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple]:
    """A block of the rows of a batch."""
    parts, entries, width = books.shape
    x = whole(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, parts * width)
    yield batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), x, [Heaps(len(x), entries) for _ in range(parts)]


def stored_blocks(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple]:
    """The blocks in the rows of a batch."""
    parts, entries, width = books.shape
    for ids, labels, kind, x, *held in zip(*(batch.column(c).to_pylist() for c in _NAMES[:-1])):
        n = len(ids)
        heaps = [Heaps(n, entries) for _ in range(parts)]
        for name, kept_, dtype in zip(("entry", "keys", "members"), held, ("<i2", "<f4", "<i4")):
            for heap, values in zip(heaps, np.frombuffer(kept_, dtype).reshape(parts, n)):
                setattr(heap, name, values.copy())
        yield ids, labels, np.frombuffer(x, kind).astype(np.int64).reshape(n, parts * width), heaps


def summed(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what has moved in all blocks: as many numbers as the codebooks have, and a count an entry."""
    size = int(np.prod(shape))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    out = np.zeros(size, np.int64)
    found = blocks.where("moved IS NOT NULL").select("moved").mapInArrow(add, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for slot, n in found.collect():
        out[slot] = n
    return out.reshape(shape)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width): the parts of the rows of the smallest vec_ids, null ones last, of equal ones by components."""
    found = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    if not found or len(found[0]) % parts:
        return None
    width = len(found[0]) // parts
    first = whole(np.array([x for x in found if len(x) == len(found[0])], np.float64))
    return first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): what each entry has moved, plus the furthest that any other one has."""
    far = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    others = np.repeat(far[:, None, :], far.shape[1], 1)
    others[:, np.arange(far.shape[1]), np.arange(far.shape[1])] = 0
    return (far + others.max(2)) * (1 + SLACK)


def fitted(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(blocks after the last assignment, codebooks): rounds of assignment and replacement, then one more assignment.

    The driver holds the codebooks, their sums and their drift, whose size parameters alone fix.
    """
    bounded_batches(rows.sparkSession)
    parts, entries, width = books.shape
    drift, sums = np.zeros((parts, entries)), np.zeros((parts, entries, width + 1), np.int64)
    blocks = rows.select("vec_id", "label", "x")
    for at in range(rounds + 1):
        blocks = stored(assigned(blocks if at == 0 else blocks.where("moved IS NULL"), books, drift, at == 0))
        if at < rounds:
            sums = sums + summed(blocks, sums.shape)
            count = sums[:, :, -1:]
            new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
            drift, books = drift + drifted(books, new), new
    return blocks.where("moved IS NULL"), books


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the blocks."""
    digits = len(f"{books.shape[1] - 1:x}") + len(f"{books.shape[1] - 1:x}") % 2
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, heaps in stored_blocks(batch, books):
                error = np.zeros(len(ids), np.int64)
                for p, held in enumerate(heaps):
                    error += ((x[:, p * width : (p + 1) * width] - books[p][held.entry]) ** 2).sum(1)
                code = ["".join(f"{e:0{digits}x}" for e in entry) for entry in zip(*(h.entry.tolist() for h in heaps))]
                columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(code, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with `label_error`: the sum of error over all rows of the label, nulls together.

    The few labels that hold much of the table are joined by broadcast, HOT_SHARE of them at most; the others by a shuffle in
    which no label has more than that share of the rows.
    """
    null, label = F.col("label").isNull().alias("_null"), F.coalesce("label", F.lit(0)).alias("_label")
    rows = rows.select("*", null, label)
    sums = stored(rows.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    least = max(1, (sums.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot, cold = sums.where(F.col("_n") > least).drop("_n"), sums.where(F.col("_n") <= least).drop("_n")
    keys = ["_null", "_label"]
    found = rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(cold, keys))
    return found.drop(*keys)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors (vec_id, embedding, label).

    Left out are rows whose vector is null or has null, infinite or undefined components and, as they have no place in the
    codebooks, those of another length than the first row's; nothing is returned if that length isn't a multiple of parts.
    A null vec_id comes last. Rows that repeat count as often as they stand there; a null label is one label. With fewer rows
    than entries, codebooks have as many entries as rows. Components beyond 65,536 count as that. Other columns are ignored.
    """
    rows = kept(vectors)
    books = first_books(rows, parts, entries)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks, books = fitted(rows.where(F.size("x") == books.shape[0] * books.shape[2]), books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = with_label_error(stored(coded(blocks, books)))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another; at most about a thousand rows are of use to it, as it scans every entry for every part."""
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, LAMBDA c: c IS NULL OR NOT isfinite(c))) = 0"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [greatest(least(floor(c::DOUBLE * {SCALE}), {MOST}), -{MOST}) FOR c IN embedding] AS x FROM embeddings WHERE {fine})",
        f"sized AS (SELECT kept.*, len(x) // {PARTS} AS width FROM kept WHERE len(x) = (SELECT len(x) FROM kept WHERE r = 1) AND len(x) % {PARTS} = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, x[p * width + 1 : p * width + width]::DOUBLE[] AS v FROM sized, range({PARTS}) AS t(p))",
        f"book0 AS (SELECT p, r - 1 AS j, v FROM parts WHERE r <= {ENTRIES})",
    ]
    near = "list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)"
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, a.p, any_value(a.v) AS v, min({{'d': {near}, 'j': b.j}}) AS m FROM parts a JOIN book{k} b USING (p) GROUP BY r, a.p)")
        if k < ROUNDS:
            steps.append(f"means{k} AS (SELECT p, j, list(floor(s / n) ORDER BY i) AS v FROM (SELECT p, m.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM near{k}, range(1, 4096) AS t(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY p, j)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} n USING (p, j))")
    steps.append(f"codes AS (SELECT r, string_agg(lower(printf('%02x', m.j)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v::BIGINT[], ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r), digest"


ORACLE = _oracle()
