"""Pages as trees: one row for each page, its nodes an array in document order.

A node's position in the array is its `pre`; `last` is the position of its last descendant. So a subtree is a slice, an
ancestor is a lookup by position, and every axis is a function of one row: no join and no shuffle. Spark has no parser of
tag soup, so that one step is Python, in Arrow batches.

HTML mode builds the tree as HTML does (`construct`); XML mode takes the nesting as it is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from pagewright.operators.construct import DEEPEST, PLAIN, parse  # noqa: F401  part of this interface

NODE = "struct<pre:int,last:int,level:int,parent:int,path:array<int>,tag:string,attrs:map<string,string>,text:string>"

WS = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
def normal(text: str) -> str:
    """White space collapsed and trimmed."""
    return WS.sub(" ", text).strip(" ")


#: Rows and bytes of pages that go to a Python worker at once, and rows that it turns into trees at once.
BATCH_ROWS, BATCH_BYTES, PIECE_ROWS = 500, 4 << 20, 50


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: a tree takes many times the bytes of its page."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def trees(pages: DataFrame, markup: str = "html", xml: bool = False, closed: bool = False) -> DataFrame:
    """pages with `nodes`, the array of its nodes, in place of the markup; a null page has none. closed: as in `parse`."""
    kept = [c for c in pages.columns if c != markup]
    schema = StructType([*pages.select(*kept).schema.fields, StructField("nodes", DataType.fromDDL(f"array<{NODE}>"))])
    places = [(x, pa.int32()) for x in ("pre", "last", "level", "parent")]
    kinds = pa.list_(pa.struct([*places, ("path", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    bounded_batches(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = pa.array([parse(x or "", xml, closed) for x in batch.column(len(kept)).to_pylist()], kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=[*kept, "nodes"])

    return pages.select(*kept, F.col(markup).cast("string")).mapInArrow(read, schema)


# --- axes: functions of the array `nodes` and of nodes in it


def root_of(nodes: Column) -> Column:
    """The whole page as a root: a node that isn't there and that holds all others."""
    return F.struct(F.lit(-1).alias("pre"), (F.size(nodes) - 1).alias("last"), F.lit(-1).alias("level"))


def inside(nodes: Column, root: Column) -> Column:
    """Nodes below root, in document order."""
    return F.when(root["last"] > root["pre"], F.slice(nodes, root["pre"] + 2, root["last"] - root["pre"])).otherwise(F.slice(nodes, 1, 0))


def select(nodes: Column, root: Column, test) -> Column:
    """Elements below root that pass test(node); the root isn't among them."""
    return F.filter(inside(nodes, root), lambda n: n["tag"].isNotNull() & test(n))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def string_value(nodes: Column, node: Column) -> Column:
    """All text below a node, as it stands; null without a node."""
    texts = F.transform(F.filter(inside(nodes, node), lambda n: n["tag"].isNull()), lambda n: n["text"])
    return F.when(node.isNotNull(), F.array_join(texts, ""))


def ancestors(nodes: Column, node: Column) -> Column:
    return F.transform(node["path"], lambda p: F.get(nodes, p))


def within(nodes: Column, node: Column, test) -> Column:
    """Whether an ancestor, of the root or beyond, passes the test."""
    return F.exists(node["path"], lambda p: test(F.get(nodes, p)))


def within_or_self(nodes: Column, node: Column, test) -> Column:
    return F.coalesce(test(node), F.lit(False)) | within(nodes, node, test)


def common_ancestor(nodes: Column, found: Column) -> Column:
    """The nearest proper ancestor of all of them; null if there is none."""
    paths = F.transform(found, lambda n: n["path"])
    shared = F.aggregate(paths, F.get(paths, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return F.when(F.size(shared) > 0, F.get(nodes, F.array_max(shared)))


def longest(nodes: Column, found: Column) -> Column:
    """The node with the longest string value; the first of several."""
    sized = F.transform(found, lambda n: F.struct(F.char_length(string_value(nodes, n)).alias("size"), (-n["pre"]).alias("order")))
    return F.when(F.size(found) > 0, F.get(nodes, -F.array_max(sized)["order"]))


# --- tests of a node


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def tag_is(*names: str):
    return lambda n: F.coalesce(n["tag"].isin(*names), F.lit(False))


def has(name: str):
    return lambda n: attr(n, name).isNotNull()


def attr_is(name: str, value):
    return lambda n: F.coalesce(attr(n, name) == value, F.lit(False))


def attr_starts(name: str, value: str):
    return lambda n: F.coalesce(attr(n, name).startswith(value), F.lit(False))


def attr_ends(name: str, value: str):
    return lambda n: F.coalesce(attr(n, name).endswith(value), F.lit(False))


def attr_contains(name: str, value: str):
    return lambda n: F.coalesce(F.contains(attr(n, name), F.lit(value)), F.lit(False))


def class_is(name: str):
    return lambda n: F.coalesce(F.array_contains(F.split(attr(n, "class"), r"[ \t\n\f\r]+"), name), F.lit(False))


def both(*tests):
    def test(n):
        out = F.lit(True)
        for t in tests:
            out = out & t(n)
        return out

    return test


def under(nodes: Column, outer, inner):
    """The test of a descendant combinator: inner, somewhere below outer, which may lie outside the root."""
    return lambda n: inner(n) & within(nodes, n, outer)
