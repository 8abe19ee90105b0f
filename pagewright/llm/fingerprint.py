"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame operations only.

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two. So the order of paragraphs doesn't count, and paragraphs are inserted or deleted by adding or
subtracting their vectors (`combine`). A vector has STRONG lanes modulo 2**32, hashes of the paragraph that make different
multisets differ, and SKETCH lanes modulo 2**32, that count the paragraph's phrases by their hash; the sketch's inner
products estimate how many phrases two documents share, which gives their likeness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG = 16
SKETCH = 64
STRONG_BITS = 32
SKETCH_BITS = 32
#: A phrase ends at the end of a clause, before a word that begins with a vowel or isn't ASCII and, where words aren't told
#: apart by spaces, before the characters of every eighth block of 256 Chinese ones, of some kana, and Thai vowels that begin a
#: syllable: wherever a text is edited, phrases elsewhere stay as they are.
HAN = "".join(chr(x) + "-" + chr(x + 255) for x in range(0x5000, 0x9F00, 2048))
PHRASE = r"[.!?;:|\n\u3001\u3002\uff01\uff0c\uff1b\uff1f\u060c\u061b\u061f\u0964]+|\s(?=[aeiouAEIOU]|[^\x00-\x7f])|(?=[\u306a-\u306f\u0e40-\u0e44" + HAN + "])"
#: Rows of a bucket of neighbouring ids, about, and quantiles from which buckets are laid out: where ids stand in clumps, a
#: bucket holds one quantile's rows at most.
BUCKET_ROWS = 1000
QUANTILES = 64
#: The table of buckets' first rows is broadcast up to so many rows (of 24 bytes); beyond, Spark joins as it sees fit.
BROADCAST_ROWS = 1_000_000


def _sums(which: Column, tag: str) -> list[Column]:
    """Aggregates that give the lanes of the rows for which `which` holds; two sketch lanes share a long."""
    head = which & (F.col("pos") == 0)
    out = []
    for i in range(STRONG // 2):
        h = F.xxhash64(F.lit(i), F.col("para"))
        out.append(F.sum(F.when(head, h.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))).alias(f"{tag}h{2 * i}"))
        out.append(F.sum(F.when(head, F.shiftrightunsigned(h, 32)).otherwise(F.lit(0))).alias(f"{tag}h{2 * i + 1}"))
    for k in range(SKETCH // 2):
        one = F.when(F.col("lane") == 2 * k, F.lit(1)).when(F.col("lane") == 2 * k + 1, F.lit(1 << 31)).otherwise(F.lit(0))
        out.append(F.sum(F.when(which, one.cast("long")).otherwise(F.lit(0).cast("long"))).alias(f"{tag}s{k}"))
    return out


def _lanes(tag: str) -> tuple[Column, Column]:
    """(strong, sketch) arrays of long from the aggregates."""
    strong = F.array(*(F.col(f"{tag}h{i}").bitwiseAND(F.lit((1 << STRONG_BITS) - 1)) for i in range(STRONG)))
    low, mask = F.lit((1 << 31) - 1), F.lit((1 << SKETCH_BITS) - 1)
    halves = [x for k in range(SKETCH // 2) for x in (F.col(f"{tag}s{k}").bitwiseAND(low), F.shiftrightunsigned(f"{tag}s{k}", 31))]
    return strong, F.array(*(x.bitwiseAND(mask) for x in halves))


def to_text(strong: Column, sketch: Column) -> Column:
    """Lanes as lower-case hex."""
    digits = lambda bits: lambda x: F.lpad(F.lower(F.hex(x)), bits // 4, "0")
    return F.concat(F.array_join(F.transform(strong, digits(STRONG_BITS)), ""), F.array_join(F.transform(sketch, digits(SKETCH_BITS)), ""))


def combine(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """Lanes of a plus, or minus, those of b: inserts, or deletes, b's paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << bits) - 1)))


def likeness(a_strong: Column, a: Column, b_strong: Column, b: Column) -> Column:
    """Shared phrases over all phrases of two documents, 0 to 1, from their lanes; 1 for equal fingerprints."""
    plus = lambda x, y: x + y
    total = lambda x: F.aggregate(x, F.lit(0.0), plus)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), plus)
    parts = F.array(F.struct(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"), total(a).alias("na"), total(b).alias("nb")))

    def ratio(p: Column) -> Column:
        # what lanes share by chance is taken off
        ab, aa, bb = (p[x] - p[y] * p[z] / SKETCH for x, y, z in (("ab", "na", "nb"), ("aa", "na", "na"), ("bb", "nb", "nb")))
        union = aa + bb - ab
        return F.when(union > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ab / union))).otherwise(F.lit(0.0))

    same = (a_strong == b_strong) & (a == b)
    return F.when(same, F.lit(1.0)).otherwise(F.transform(parts, ratio)[0])


def fingerprints(rows: DataFrame, key: Sequence[str], texts: dict[str, str]) -> DataFrame:
    """The key columns, and for each (tag, column of rows) `{tag}_strong` and `{tag}_sketch`; a null text counts as empty.

    key must name a row; rows that are already partitioned by part of it aren't shuffled again.
    """
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(texts.values()))))
    lines = rows.select(*key, one.alias("x")).select(*key, "x.kind", F.explode(F.split("x.text", "\n", -1)).alias("para"))
    phrases = lines.select(*key, "kind", "para", F.posexplode(F.split("para", PHRASE, -1)).alias("pos", "phrase"))
    phrases = phrases.withColumn("lane", F.when(F.col("phrase") == "", F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SKETCH))))
    sums = phrases.groupBy(*key, "kind").agg(*_sums(F.lit(True), "x"))
    strong, sketch = _lanes("x")
    lanes = sums.select(*key, "kind", F.struct(strong.alias("strong"), sketch.alias("sketch")).alias("lanes"))
    found = lanes.groupBy(*key).agg(*(F.max(F.when(F.col("kind") == i, F.col("lanes"))).alias(tag) for i, tag in enumerate(texts)))
    return found.select(*key, *(F.col(f"{t}.{part}").alias(f"{t}_{part}") for t in texts for part in ("strong", "sketch")))


def bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with `bucket`, and how many buckets there may be: ascending ranges of doc_id of about BUCKET_ROWS rows; null ids come first, in bucket -1.

    Ranges come from approximate quantiles and are divided evenly between them: a fixed expression of doc_id, so that what
    is recomputed after a loss lands where it was.
    """
    share = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", share, 20 * QUANTILES).alias("at")).first()
    at = sorted(set(found["at"] or [0]))
    each = max(1, found["n"] // BUCKET_ROWS // max(1, len(at) - 1) + 1)
    id_ = F.col("doc_id")

    def within(lo: int, hi: int) -> Column:
        """The bucket, if the id is in the quantiles lo to hi - 1."""
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(id_ < at[mid], within(lo, mid)).otherwise(within(mid, hi))
        width = max(1, -(-(at[hi] - at[lo]) // each))
        return lo * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((id_ - at[lo]) / F.lit(width)).cast("long")))

    inner = within(0, len(at) - 1) if len(at) > 1 else F.lit(0).cast("long")
    return docs.withColumn("bucket", F.when(id_.isNull(), F.lit(-1).cast("long")).otherwise(inner)), each * len(at) + 1


def with_next(rows: DataFrame, column: str, tie: str, out: str, buckets: int) -> DataFrame:
    """rows (bucket, doc_id, ...) with `out`: `column` of the row that comes next by (doc_id, tie); the last row gets the first's.

    Within a bucket that is a window; a bucket's last row gets the first row of the next bucket that has any, from a table of
    one row for each bucket.
    """
    order = (F.col("doc_id").asc_nulls_first(), F.col(tie).asc_nulls_first())
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    whole = Window.orderBy("bucket")  # one row for each bucket
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(whole), F.max("bucket").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    if buckets <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    heads = rows.alias("r").join(firsts.alias("f"), (F.col("r.bucket") == F.col("f.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")))
    heads = heads.select(F.col("f.before").alias("bucket"), F.struct(F.col(f"r.{tie}").alias("t"), F.coalesce(F.col(f"r.{column}"), F.lit("")).alias("x")).alias("head"))
    heads = heads.groupBy("bucket").agg(F.min("head").alias("head"))
    own = Window.partitionBy("bucket").orderBy(*order)
    nexts = rows.withColumn(out, F.lead(F.coalesce(F.col(column), F.lit(""))).over(own)).join(heads, "bucket", "left")
    return nexts.withColumn(out, F.coalesce(F.col(out), F.col("head.x"))).drop("head")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    An edited text has the last quarter (rounded down) of the text's code points replaced by as many of the next document's,
    or all that it has. Next is the next row by doc_id, then text; after the last comes the first, which may be itself. A null
    text counts as empty; a null doc_id comes before all others. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows, buckets = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    rows = with_next(rows, "text", "text", "next", buckets)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("bucket", "doc_id", F.row_number().over(order).alias("nth"), "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next")
    # within a bucket the next row has the next fingerprint; only for a bucket's last row it is made from the text
    rows = rows.withColumn("after", F.when(F.lead("nth").over(Window.partitionBy("bucket").orderBy("nth")).isNull(), F.col("next"))).drop("next")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    key = ("bucket", "doc_id", "nth", "n_chars", "edited_sha256")
    prints = fingerprints(rows, key, {"own": "text", "edited": "edited", "after": "after"})
    nth = Window.partitionBy("bucket").orderBy("nth")
    for part in ("strong", "sketch"):
        prints = prints.withColumn(f"next_{part}", F.coalesce(F.lead(f"own_{part}").over(nth), F.col(f"after_{part}")))
    near = lambda x: likeness(F.col("own_strong"), F.col("own_sketch"), F.col(f"{x}_strong"), F.col(f"{x}_sketch"))
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.col("own_strong"), F.col("own_sketch")).alias("fingerprint"),
        to_text(F.col("edited_strong"), F.col("edited_sketch")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )
