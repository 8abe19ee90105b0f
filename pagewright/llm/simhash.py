"""SimHash near-duplicates, linked by a self-join of a binary trie.

Every text gets a 64-bit fingerprint. Two fingerprints are linked when at most BUDGET bits differ. The bits are dealt
into five blocks; fingerprints within three bits agree in two blocks at least, so each of the ten pairs of blocks gives
one forest of tries, keyed by the two blocks. Within a trie the join starts at the pair (root, root), goes down both
nodes together, adds a bit to the pair's error where the branches differ, and drops the pair once the error is over the
budget. A key with more than HOT fingerprints is dealt again: by the next TOP bits of both nodes of a pair, which starts
the same traversal lower down, in as many tasks as there are node pairs within the budget.

Links are contracted to spanning forests where they are found, then to components by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ample, bounded_batches, hash_share, stored

SHINGLE = 3
BUDGET = 3
SEED = 42
#: (offset, width) of the blocks, from bit 0.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
HOT = 20_000
TOP = 12
#: Ids of 8 bytes that a broadcast may hold; beyond, documents are joined by shuffling both sides.
BROADCAST_IDS = 1_000_000
#: Fingerprints that hot keys are looked for in, and how many of them a hot key has at least.
SEEN, MANY = 50_000, 50
#: A fingerprint of more rows than this, and than one in COMMON of all, is joined to its rows by a broadcast (of COMMON rows at most).
COPIES, COMMON = 1000, 10_000
#: Node pairs and shingles handled at once.
FRONTIER = 1 << 18
CHUNK = 1 << 16


def simhash(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text: bit b is set if it is set in over half of the hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp BIGINT) of every row of docs (doc_id, text, ...); a null or wordless text has fingerprint 0."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def unite(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u[i] and v[i]; labels[x] is a smaller member of x's class, or x."""
    while len(u):
        a, b = labels[u], labels[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def traverse(bits: np.ndarray, width: int, pairs: tuple[np.ndarray, ...], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget under the given node pairs.

    bits: the `width` low bits of the keys, ascending within a node. pairs: arrays (a_from, a_to, b_from, b_to, error);
    a pair of a node with itself stands for the pairs inside it.
    """
    below: dict[int, np.ndarray] = {}
    stack = [(width - 1, *pairs)]
    while stack:
        p, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(p, *(x[:half] for x in (al, ah, bl, bh, err))), (p, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            rest = bits[a] ^ bits[b]
            if p < 63:
                rest = rest & np.uint64((1 << (p + 1)) - 1)
            near = (a != b) & (err[single] + np.bitwise_count(rest) <= budget)
            if near.any():
                yield a[near], b[near]
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if not len(al) or p < 0:
            continue
        if p not in below:
            below[p] = np.concatenate([[0], np.cumsum((bits >> np.uint64(p)) & np.uint64(1), dtype=np.int64)])
        ones = below[p]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = al == bl
        kids = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            tuple(x[~own] for x in (am, ah, bl, bm, err + 1)),
        ]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        keep = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        if keep.any():
            stack.append((p - 1, *(x[keep] for x in (al, ah, bl, bh, err))))


def _without(fp: np.ndarray, table: int) -> tuple[np.ndarray, int]:
    """The bits of fp outside the key of a table, packed, and how many they are."""
    out, width = np.zeros(len(fp), np.uint64), 0
    for block, (offset, size) in enumerate(BLOCKS):
        if block not in TABLES[table]:
            out |= ((fp >> np.uint64(offset)) & np.uint64((1 << size) - 1)) << np.uint64(width)
            width += size
    return out, width


def _forest(tab: np.ndarray, group: np.ndarray, item: np.ndarray | None, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the links within each group (rows of a group are of one table and stand together)."""
    for t in np.unique(tab):
        at = tab == t
        f, g, it = fp[at], group[at], None if item is None else item[at]
        bits, width = _without(f, int(t))
        order = np.lexsort((bits, g))
        f, g, bits, it = f[order], g[order], bits[order], None if it is None else it[order]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        end = np.concatenate([start[1:], [len(g)]])
        if it is None:
            own = end - start > 1
            start, end = start[own], end[own]
            pairs = (start, end, start, end, np.zeros(len(start), np.int64))
        else:
            low = np.int64(1 << TOP)
            top = (bits >> np.uint64(width - TOP)).astype(np.int64)
            p, q = it[start] // low, it[start] % low
            mid = start + np.add.reduceat((top == np.repeat(p, end - start)).astype(np.int64), start)
            two = p != q
            pairs = (start, np.where(two, mid, end), np.where(two, mid, start), end, np.bitwise_count(p ^ q).astype(np.int64))
            ok = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (two | (end - start > 1))
            pairs = tuple(x[ok] for x in pairs)
            width -= TOP
            bits = bits & np.uint64((1 << width) - 1)
        labels = np.arange(len(f))
        for u, v in traverse(bits, width, pairs, BUDGET):
            unite(labels, u, v)
        moved = np.flatnonzero(labels != np.arange(len(f)))
        if len(moved):
            yield f[moved], f[labels[moved]]


def _join_groups(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (tab, key, item, fp) sorted by (tab, key, item) to (tab, a, b): links, or with tab >= 0 rows of a group too large to join here."""

    def out(tab, a, b):
        return pa.RecordBatch.from_arrays([pa.array(tab.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["tab", "a", "b"])

    def joined(rows):
        if len(rows[0]):
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)])
            for u, v in _forest(rows[0], np.cumsum(new), None if hot else rows[2], rows[3]):
                yield out(np.full(len(u), -1), u, v)

    rest: list[list[np.ndarray]] = []  # the last group so far, in parts
    held = 0
    flowing = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        rows[3] = rows[3].view(np.uint64)
        if not len(rows[0]):
            continue
        if flowing is not None:  # the rest of a large group goes through
            same = (rows[0] == flowing[0]) & (rows[1] == flowing[1])
            if same.any():
                yield out(rows[0][same], rows[3][same], rows[3][same])
            rows = [x[~same] for x in rows]
            if not len(rows[0]):
                continue
            flowing = None
        last = np.all([x == x[-1] for x in rows[:3]], axis=0)
        if not last.all() or rest and any(x[0] != y[-1] for x, y in zip(rows[:3], rest[0][:3], strict=True)):
            yield from joined([np.concatenate(x) for x in zip(*rest, [x[~last] for x in rows], strict=True)])
            rest, held = [], 0
        rest.append([x[last] for x in rows])
        held += int(last.sum())
        if hot and held > hot:
            flowing = (rest[0][0][0], rest[0][1][0])
            for part in rest:
                yield out(part[0], part[3], part[3])
            rest, held = [], 0
    if rest:
        yield from joined([np.concatenate(x) for x in zip(*rest, strict=True)])


def _hot_keys(prints: DataFrame, dealt: DataFrame, hot: int) -> DataFrame | None:
    """Keys (tab, key) that by a sample of SEEN fingerprints have over twice `hot` rows: a bounded table, as each has MANY of the sample. None without any."""
    share = ample(SEEN, F.lit(prints.count()))
    many = F.greatest(F.lit(MANY), F.lit(2.0 * hot) * share)
    found = dealt.where(hash_share("fp", share)).groupBy("tab", "key").count().where(F.col("count") > many).select("tab", "key")
    found = stored(found)
    return None if found.isEmpty() else found


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) with the same components as all pairs of distinct fingerprints within BUDGET bits. prints: (fp), distinct."""
    def block(b: int):
        return F.shiftrightunsigned("fp", BLOCKS[b][0]).bitwiseAND(F.lit((1 << BLOCKS[b][1]) - 1))

    keys = F.array(*(F.struct(F.lit(t).alias("tab"), (block(x) * (1 << BLOCKS[y][1]) + block(y)).alias("key")) for t, (x, y) in enumerate(TABLES)))
    dealt = prints.select("fp", F.inline(keys)).select("tab", "key", F.lit(0).cast("long").alias("item"), "fp")
    schema = "tab int, a long, b long"

    def joined(rows: DataFrame, limit: int | None) -> DataFrame:
        rows = rows.repartition("tab", "key", "item").sortWithinPartitions("tab", "key", "item")
        return rows.mapInArrow(lambda it: _join_groups(it, limit), schema)

    known = _hot_keys(prints, dealt, hot)
    at_once = None
    if known is not None:  # their rows needn't be gathered to be seen to be many
        at_once = dealt.join(F.broadcast(known), ["tab", "key"], "left_semi").select("tab", F.col("fp").alias("a"))
        dealt = dealt.join(F.broadcast(known), ["tab", "key"], "left_anti").select("tab", "key", "item", "fp")
    first = stored(joined(dealt, hot))
    found = first.where("tab < 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = first.where("tab >= 0").select("tab", "a")
    if at_once is not None:
        large = large.unionByName(at_once)
    elif large.isEmpty():
        return found
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << TOP) - 1).cast("long")), lambda m: F.bit_count(m) <= BUDGET)
    tops = F.lit(None).cast("long")
    for t, pair in enumerate(TABLES):
        packed, width = F.lit(0).cast("long"), 0
        for b, (_, size) in enumerate(BLOCKS):
            if b not in pair:
                packed, width = packed + F.shiftleft(block(b), width), width + size
        tops = F.when(F.col("tab") == t, F.shiftrightunsigned(packed, width - TOP)).otherwise(tops)
    again = large.select("tab", F.col("a").alias("fp")).withColumn("top", tops).select("tab", "fp", "top", F.explode(masks).alias("m"))
    other = F.col("top").bitwiseXOR(F.col("m"))
    key = F.lit(0).cast("long")
    for t, (x, y) in enumerate(TABLES):
        key = F.when(F.col("tab") == t, block(x) * (1 << BLOCKS[y][1]) + block(y)).otherwise(key)
    again = again.select("tab", key.alias("key"), (F.least("top", other) * (1 << TOP) + F.greatest("top", other)).alias("item"), "fp")
    return found.unionByName(joined(again, None).select(F.col("a").alias("u"), F.col("b").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node of its component, by alternating stars."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while True:
        sym = both(edges)
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    Equal and near texts share component_id, the least doc_id of the component. A null text counts as empty; empty texts have
    fingerprint zero and are linked like others. Rows that repeat stay. An empty table gives none. Columns other than doc_id
    and text aren't read. A null doc_id stays null and is no component's id, unless the whole component has null ids.
    """
    prints = stored(fingerprints(docs))
    each = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    comp = components(links(each.select("fp"), hot))
    linked = each.join(comp, each.fp == comp.node).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select(F.col("fp").alias("node"), "component")
    known = stored(each.join(linked, each.fp == linked.node, "left").select("fp", "copies", F.coalesce("component", "first").alias("component_id")))
    # rows of a fingerprint that very many have stay where they are
    rows = each.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") > max(COPIES, rows // COMMON)
    by_fp = known.drop("copies")
    few = F.broadcast(known.where(common).drop("copies"))
    found = prints.join(few, "fp").unionByName(prints.join(few, "fp", "left_anti").join(by_fp, "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id.

    Of rows that repeat its id one stays. Rows whose doc_id is null can't be told apart by it: all of them stay. What is
    joined to docs is the table of ids that don't simply stay: broadcast up to broadcast_ids of them, merged beyond.
    """
    ids = near_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(F.col("doc_id") == F.col("component_id")).alias("least"))
    special = stored(ids.where("doc_id IS NOT NULL AND (copies > 1 OR NOT least)"))
    count = special.agg(F.count("*"), F.count_if("least")).first()
    way = "broadcast" if count[0] <= broadcast_ids else "merge"
    kept = docs.join(special.select("doc_id").hint(way), "doc_id", "left_anti").select(docs.columns)
    if count[1]:
        repeated = docs.join(special.where("least").select("doc_id").hint(way), "doc_id", "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id"]).select(docs.columns))
    return kept
