"""Mixing sources to target weights, in DataFrame operations only.

A source's documents are dealt by hash into blocks of some BLOCK_WORDS words. The mix takes all blocks as often as the source's
target holds it whole, and then blocks in a permuted order until the rest is reached; of the block in which that falls, as many
documents as fit. So each source has an exact quota of block draws. A tree over output shards splits the quotas: each node deals
its block draws to its two halves as if they were drawn blindly, source by source from the multivariate hypergeometric
distribution, down to single shards. A shard takes the next permuted blocks of each source, disjoint from all others', and
shuffles their documents by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored

#: Fixed values of the query: weights, repeating over the sources in order, and the most that a source is repeated.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block and blocks of a shard, about.
BLOCK_WORDS, SHARD_BLOCKS = 32_768, 32
#: Equal rows are dealt in chunks of so many.
CHUNK = 1000
#: Blocks are summed up in order within groups of this power of two, then over groups.
GROUP_BITS = 12
#: The table of sources is broadcast up to so many rows; beyond, it is joined by salted keys.
BROADCAST_ROWS, SALTS = 100_000, 64
SEED = 12
#: After so many levels of the tree its nodes are dealt anew over the tasks.
SPREAD_LEVELS = 6


def sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, n): the rows of docs with n of equal ones as one; size is the number of words."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("source", F.col("doc_id").cast("long"), size.alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_id, source_size, target, blocks, copies, rest) of each source in rows (source, size, n).

    All sizes are shared out by weight; a target stops at `most` times its source's size and the excess is shared out again.
    In the order of cap over weight, a source is capped if its share of what the ones before leave reaches its cap. The mix
    has `copies` whole copies and `rest` words of one more.
    """
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    found = found.withColumn("source_id", number.cast("long")).withColumn("cap", most * F.col("source_size"))
    found = found.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_id") - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    found = found.withColumn("capped", F.col("cap").cast("double") * weight <= left.cast("double") * F.col("w"))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(every), F.lit(0))
    share = (F.sum("source_size").over(every) - capped("cap")).cast("double") * F.col("w") / (F.sum("w").over(every) - capped("w"))
    found = found.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    whole = (F.col("source_size") / BLOCK_WORDS).cast("long")
    blocks = F.when(whole == 0, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(whole))))
    copies = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    found = found.withColumn("blocks", blocks).withColumn("copies", copies)
    return found.select("source", "source_id", "source_size", "target", "blocks", "copies", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long").alias("rest"))


def with_sources(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """rows joined to their source's row: by broadcast if there are few sources, else by keys that a salt parts, so that no task gets a source whole."""
    null, name = F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source")
    sources, rows = sources.select(null, name, *(c for c in sources.columns if c != "source")), rows.select("*", null, name)
    if number <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sources), ["_null", "_source"]).drop("_null", "_source")
    sources = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return rows.join(sources, ["_null", "_source", "_salt"]).drop("_null", "_source", "_salt")


def dealt(rows: DataFrame) -> DataFrame:
    """rows (doc_id, size, n, blocks, ..) in chunks of equal rows, with `key`, a hash, and `block`, the one it leads to."""
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))))
    rows = rows.withColumn("n", F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("chunk") * CHUNK))
    parts = F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("chunk").cast("string"))
    key = F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.withColumn("key", key).withColumn("block", F.col("key") % F.col("blocks"))


def place(block: Column, copy: Column, blocks: Column) -> Column:
    """Where a block stands in the permutation of a copy; blocks is a power of two and the factor odd, so no two meet."""
    return (block * ((2 * copy + 1) * 40503) + copy * 12289) % blocks


def drawn_blocks(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, block, copy, draw, left): every block draw of the mix, numbered within its source; left: words wanted of a block that isn't wanted whole.

    The partial copy's blocks are summed up in the order of their places, within groups and over them, so no task gets a
    source's blocks at once.
    """
    keep = sources.select("source_id", "blocks", "copies", "rest")
    held = items.groupBy("source_id", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words")).join(keep, "source_id")
    last = held.where("rest > 0").withColumn("at", place(F.col("block"), F.col("copies"), F.col("blocks")))
    last = last.withColumn("group", F.shiftright("at", GROUP_BITS))
    groups = last.groupBy("source_id", "group").agg(F.sum("words").alias("words"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source_id", "group", F.coalesce(F.sum("words").over(up_to(Window.partitionBy("source_id").orderBy("group"))), F.lit(0)).alias("_start"))
    within = F.sum("words").over(up_to(Window.partitionBy("source_id", "group").orderBy("at")))
    last = last.join(groups, ["source_id", "group"]).withColumn("before", F.col("_start") + F.coalesce(within, F.lit(0))).where("before < rest")
    left = F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before"))
    last = last.select("source_id", "block", F.col("copies").alias("copy"), (F.col("copies") * F.col("blocks") + F.col("at")).alias("draw"), left.alias("left"))
    copies = held.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    number = F.col("copy") * F.col("blocks") + place(F.col("block"), F.col("copy"), F.col("blocks"))
    return copies.select("source_id", "block", "copy", number.alias("draw"), F.lit(None).cast("long").alias("left")).unionByName(last)


def let(values: dict[str, Column], body) -> Column:
    """body of the values, each computed once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, for u uniform in 0 to 1.

    Chances are relative to the most likely number's; they are summed up and gone through from it upwards, then downwards, as
    far as ten standard deviations.
    """
    n, k, m = (c.cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")))
    spread = F.ceil(10 * F.sqrt(F.coalesce(F.try_divide(m * k * (n - k) * (n - m), n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))).cast("long") + 10
    bounds = let({"mode": mode, "low": low, "high": high, "spread": spread}, lambda v: F.struct(v["mode"].alias("mode"), F.greatest(v["low"], v["mode"] - v["spread"]).alias("low"), F.least(v["high"], v["mode"] + v["spread"]).alias("high")))
    none = F.array().cast("array<long>")

    def up(x: Column) -> Column:
        return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    def down(x: Column) -> Column:
        return x * (n - k - m + x) / ((k - x + 1) * (m - x + 1))

    def ways(b: Column) -> tuple[tuple[Column, Column, int], ...]:
        """(numbers to step from, chance of the next over that one's, what a step adds)"""
        rising = F.when(b["high"] > b["mode"], F.sequence(b["mode"], b["high"] - 1)).otherwise(none)
        falling = F.when(b["low"] < b["mode"], F.sequence(b["mode"], b["low"] + 1, F.lit(-1).cast("long"))).otherwise(none)
        return (rising, up, 1), (falling, down, -1)

    def mass(numbers: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(numbers, start, lambda s, x: let({"w": s["w"] * ratio(x)}, lambda v: F.struct(v["w"].alias("w"), (s["sum"] + v["w"]).alias("sum"))), lambda s: s["sum"])

    def walk(ratio, by: int):
        """A step is made as long as the chance that is left isn't used up."""

        def step(s: Column, x: Column) -> Column:
            more = let({"w": s["w"] * ratio(x)}, lambda v: F.struct(v["w"].alias("w"), (s["left"] - v["w"]).alias("left"), (x + by).alias("at")))
            return F.when(s["left"] < 0, s).otherwise(more)

        return step

    def pick(b: Column) -> Column:
        (rising, r, _), (falling, f, _) = ways(b)
        state = F.struct(F.lit(1.0).alias("w"), (u * (1 + mass(rising, r) + mass(falling, f)) - 1).alias("left"), b["mode"].alias("at"))
        for numbers, ratio, by in ways(b):
            state = F.aggregate(numbers, state, walk(ratio, by), lambda s: F.struct(F.lit(1.0).alias("w"), s["left"].alias("left"), s["at"].alias("at")))
        return state["at"]

    return F.when(low == high, low).otherwise(F.transform(F.array(bounds), pick)[0])


def uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def split(nodes: DataFrame) -> DataFrame:
    """nodes (shard, shards, blocks, quotas) one level further down: those of several shards as their two halves."""
    half = F.floor(F.col("shards") / 2).cast("long")
    share = F.floor(F.col("blocks") * half / F.col("shards")).cast("long")
    start = F.struct(F.col("blocks").alias("rest"), share.alias("want"), F.array().cast("array<long>").alias("out"))

    def draw(s: Column, q: Column) -> Column:
        k = hypergeometric(s["rest"], q["count"], s["want"], uniform(F.lit(SEED), F.col("shard"), F.col("shards"), q["source_id"]))
        return let({"k": k}, lambda v: F.struct((s["rest"] - q["count"]).alias("rest"), (s["want"] - v["k"]).alias("want"), F.concat(s["out"], F.array(v["k"])).alias("out")))

    nodes = nodes.withColumn("half", half).withColumn("share", share).withColumn("drawn", F.when(F.col("shards") > 1, F.aggregate("quotas", start, draw, lambda s: s["out"])))
    quota = lambda q, count, first: F.struct(q["source_id"].alias("source_id"), count.alias("count"), first.alias("first"))
    some = lambda quotas: F.filter(quotas, lambda q: q["count"] > 0)
    left = some(F.zip_with("quotas", "drawn", lambda q, k: quota(q, k, q["first"])))
    right = some(F.zip_with("quotas", "drawn", lambda q, k: quota(q, q["count"] - k, q["first"] + k)))
    node = lambda shard, shards, blocks, quotas: F.struct(shard.alias("shard"), shards.alias("shards"), blocks.alias("blocks"), quotas.alias("quotas"))
    shard, shards, blocks = F.col("shard"), F.col("shards"), F.col("blocks")
    halves = F.array(node(shard, F.col("half"), F.col("share"), left), node(shard + F.col("half"), shards - F.col("half"), blocks - F.col("share"), right))
    return nodes.select(F.explode(F.when(shards > 1, halves).otherwise(F.array(node(shard, shards, blocks, F.col("quotas"))))).alias("x")).select("x.*")


def shard_quotas(draws: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, source_id, count, first): of each source a shard's number of draws, and the first of them.

    draws: (source_id, draw). One number comes to the driver. A node holds a number for each of its sources.
    """
    quotas = draws.groupBy("source_id").agg((F.max("draw") + 1).alias("count"))
    total = F.sum("count").alias("blocks")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("count") / shard_blocks).cast("long")).alias("shards")
    listed = F.array_sort(F.collect_list(F.struct("source_id", "count", F.lit(0).cast("long").alias("first")))).alias("quotas")
    nodes = stored(quotas.agg(F.lit(0).cast("long").alias("shard"), shards, total, listed))
    for level in range(math.ceil(math.log2(nodes.first()["shards"] or 1))):
        if level and level % SPREAD_LEVELS == 0:
            nodes = nodes.repartition("shard")
        nodes = split(nodes)
    return nodes.select("shard", F.explode("quotas").alias("q")).select("shard", "q.*")


def fitted(items: DataFrame) -> DataFrame:
    """items of blocks that aren't wanted whole, with `fit`: how many of n rows the mix takes of the words `left`.

    In the order of their keys each takes what still fits; then the smallest one that is left, if that comes nearer. A block
    holds some BLOCK_WORDS words, so its list is bounded; texts without words aren't in it and take nothing.
    """
    names = ["key", "doc_id", "size", "chunk", "n", "draws"]
    listed = items.where("size > 0").groupBy("source_id", "block", "left").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("x"))
    start = F.struct(F.col("left"), F.array().cast("array<long>").alias("fit"))

    def take(s: Column, x: Column) -> Column:
        return let({"k": F.least(x["n"], F.floor(s["left"] / x["size"]).cast("long"))}, lambda v: F.struct((s["left"] - v["k"] * x["size"]).alias("left"), F.concat(s["fit"], F.array(v["k"])).alias("fit")))

    taken = listed.withColumn("s", F.aggregate("x", start, take))
    rests = F.filter(F.zip_with("x", F.sequence(F.lit(0), F.size("x") - 1), lambda x, i: F.struct(x["size"].alias("size"), i.alias("i"), x["n"].alias("n"))), lambda r: F.get("s.fit", r["i"]) < r["n"])
    taken = taken.withColumn("least", F.array_min(rests))
    more = lambda i: F.when(F.coalesce((F.col("least.i") == i) & (F.col("least.size") < 2 * F.col("s.left")), F.lit(False)), 1).otherwise(0)
    taken = taken.select("source_id", "block", F.posexplode("x").alias("i", "x"), "s", "least")
    fit = (F.get("s.fit", F.col("i")) + more(F.col("i"))).alias("fit")
    none = items.where("size = 0").select("source_id", "block", *names, F.lit(0).cast("long").alias("fit"))
    return taken.select("source_id", "block", "x.*", fit).unionByName(none)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, doc_id, size, source_size, target, key, nth, draws) of every row of docs (doc_id, text, source).

    draws is an array of (copy, shard), one for each time that the mix takes the document. Weights go to the sources in
    order of code points, null last, over and over; the words of all documents are shared out by them, none over `most` times
    its source's size. Documents are taken whole, so each source comes as near its target as its smaller documents allow.
    A null text has no words; it and others without words take part and add nothing. Rows that repeat are told apart by
    `nth` alone. What is drawn depends on doc_id, size and source only, so reruns agree. Other columns are ignored.
    """
    rows = stored(sizes(docs))
    sources = stored(targets(rows, weights, most))
    items = stored(dealt(with_sources(rows, sources, sources.count())))
    draws = stored(drawn_blocks(items, sources))
    shards = shard_quotas(draws).withColumn("draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    found = draws.join(shards.select("source_id", "draw", "shard"), ["source_id", "draw"])
    lists = found.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws"), F.max("left").alias("left"))
    own = stored(items.drop("blocks", "copies", "rest").join(lists, ["source_id", "block"], "left"))
    names = ["source", "source_id", "block", "doc_id", "size", "chunk", "n", "key", "source_size", "target"]
    whole = own.where("left IS NULL").select(*names, F.coalesce("draws", F.array().cast("array<struct<copy:bigint,shard:bigint>>")).alias("draws"), F.col("n").alias("fit"))
    some = own.where("left IS NOT NULL")
    part = fitted(some).join(some.select("source_id", "block", "source", "source_size", "target").distinct(), ["source_id", "block"])
    every = whole.unionByName(part.select(*names, "draws", "fit"))
    # of a block that isn't wanted whole the last copy is the partial one
    mine = lambda nth: F.when(nth < F.col("fit"), F.col("draws")).otherwise(F.slice("draws", F.lit(1), F.greatest(F.lit(0), F.size("draws") - 1)))
    every = every.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return every.select("source", "doc_id", "size", "source_size", "target", "key", (F.col("chunk") * CHUNK + F.col("nth")).alias("nth"), mine(F.col("nth")).alias("draws"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(shard, position, doc_id, copy, size): the mix itself; each shard, of some SHARD_BLOCKS blocks, is shuffled by itself."""
    rows = mixture(docs, weights, most).select("doc_id", "key", "nth", "size", F.explode("draws").alias("d")).select("*", "d.copy", "d.shard")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "key", "nth", "copy"), "key", "nth", "copy")
    return rows.select("shard", F.row_number().over(order).cast("long").alias("position"), "doc_id", "copy", "size")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs: the words that the mix takes of it."""
    return mixture(docs, weights, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


#: The words taken don't depend on how the tree deals blocks to shards; SQL leaves it out.
ORACLE = rf"""WITH rows_ AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, count(*) AS n FROM documents GROUP BY ALL),
named AS (SELECT source, sum(size * n)::BIGINT AS source_size FROM rows_ GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_id, {MOST} * source_size AS cap FROM named),
weighed AS (SELECT *, ({list(WEIGHTS)})[(source_id - 1) % {len(WEIGHTS)} + 1] AS w FROM numbered),
left_ AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS words, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight FROM weighed
  WINDOW b AS (ORDER BY cap / w, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap::DOUBLE * weight::DOUBLE <= words::DOUBLE * w AS c FROM left_),
shared AS (SELECT *, CASE WHEN c THEN cap::DOUBLE ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (c) OVER (), 0))::DOUBLE * w / (sum(w) OVER () - coalesce(sum(w) FILTER (c) OVER (), 0))::DOUBLE END AS target FROM capped),
sources AS (SELECT source, source_id, source_size, target, CASE WHEN source_size < {BLOCK_WORDS} THEN 1 ELSE 1::BIGINT << length(bin(source_size // {BLOCK_WORDS})) END AS blocks,
  CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies FROM shared),
wanted AS (SELECT *, round(target - copies * source_size)::BIGINT AS rest FROM sources),
chunks AS (SELECT r.source, doc_id, size, least({CHUNK}, n - chunk * {CHUNK}) AS n, chunk, source_id, source_size, target, blocks, copies, rest,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || chunk), 1, 15))::BIGINT AS key
  FROM (SELECT *, unnest(range((n - 1) // {CHUNK} + 1)) AS chunk FROM rows_) r JOIN wanted s ON r.source IS NOT DISTINCT FROM s.source),
items AS (SELECT *, key % blocks AS block FROM chunks),
held AS (SELECT source_id, block, rest, (block * ((2 * copies + 1) * 40503) + copies * 12289) % blocks AS place, sum(size * n)::BIGINT AS words FROM items GROUP BY ALL),
summed AS (SELECT source_id, block, rest, words, coalesce(sum(words) OVER (PARTITION BY source_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM held),
extra AS (SELECT source_id, block, before < rest AS more, CASE WHEN before < rest AND before + words > rest THEN rest - before END AS part FROM summed),
lists AS (SELECT source_id, list({{'key': key, 'doc_id': coalesce(doc_id, -9223372036854775807), 'size': size, 'chunk': chunk, 'n': n}} ORDER BY key, doc_id NULLS FIRST, size, chunk) AS x, any_value(part) AS part
  FROM items JOIN extra USING (source_id, block) WHERE part IS NOT NULL AND size > 0 GROUP BY source_id),
folded AS (SELECT source_id, x, list_reduce(x, LAMBDA s, y: {{'rest': s.rest - least(y.n, s.rest // y.size) * y.size, 'fit': list_append(s.fit, least(y.n, s.rest // y.size))}}, {{'rest': part, 'fit': []::BIGINT[]}}) AS s FROM lists),
leasts AS (SELECT source_id, x, s, list_min([[x[i].size, i] FOR i IN range(1, len(x) + 1) IF s.fit[i] < x[i].n]) AS least FROM folded),
fits AS (SELECT source_id, unnest([{{'key': x[i].key, 'doc_id': x[i].doc_id, 'size': x[i].size, 'chunk': x[i].chunk, 'fit': s.fit[i] + CASE WHEN least[2] = i AND least[1] < 2 * s.rest THEN 1 ELSE 0 END}} FOR i IN range(1, len(x) + 1)]) AS f FROM leasts),
every AS (SELECT i.doc_id, i.size, source_size, target, copies, unnest(range(n)) AS nth, CASE WHEN part IS NOT NULL THEN coalesce(f.fit, 0) WHEN more THEN n ELSE 0 END AS fit
  FROM items i JOIN extra USING (source_id, block) LEFT JOIN fits ON fits.source_id = i.source_id AND f.key = i.key AND f.doc_id = coalesce(i.doc_id, -9223372036854775807) AND f.size = i.size AND f.chunk = i.chunk)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN nth < fit THEN 1 ELSE 0 END) AS taken FROM every"""
