"""Sources and sinks: pages, source trees, JSON files, pre-extracted PDF items, result tables, and scans of source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.sources.script import BINDING, COMPUTED, IDENTIFIER, MEMBER, STRING, code_nodes

#: Names that may not be used, script files, and what a document must have to count as readable.
NETWORK = ("fetch", "XMLHttpRequest", "WebSocket", "EventSource")
SCRIPTS = "*.{ts,tsx,js,jsx,mts,mtsx,mjs,mjsx,cts,ctsx,cjs,cjsx}"
MIN_EXTRACTED = 200


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of page captures, a whole file each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def write_captures(pages_of: DataFrame, path: str) -> None:
    """Page captures as lines of JSON, a whole page each, many to a file: as many files as tasks, however many pages."""
    pages_of.select(F.to_json(F.struct(*pages_of.columns)).alias("value")).write.option("lineSep", "\n").text(path)


def captures(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The page captures that were written so. Any text comes back as it was, line ends, U+0000 and null too."""
    return spark.read.schema(schema).option("maxStringLen", 2**31 - 1).json(path, lineSep="\n", mode="FAILFAST")


def source_tree(spark: SparkSession, path: str, pattern: str = SCRIPTS) -> DataFrame:
    """(path, code) of the files below a folder whose names match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("code"))


def json_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


#: Items whose baselines lie no further apart are of one line; an empty strip of this width parts columns; wider items than this share of the page part none.
BASELINE, GUTTER, WIDE = 2.0, 18.0, 0.6
#: Items that a task lays out, about: there are as many tasks as they take.
TASK_ITEMS = 500_000


def lines_of_items(items: DataFrame, key: str, tolerance: float = BASELINE, gutter: float = GUTTER) -> DataFrame:
    """(key, page, column, line, y, text): PDF text items (key, page, x, y, text) as lines, top down, each from left to right.

    Baselines are followed from item to item within the tolerance, so a line may waver or slope. Where items have a `width`,
    columns are told apart by strips of the page that no item reaches into; wide ones, such as headings, don't count and go to
    the column in which they begin. y is the line's least. Lines are numbered in each column; those without text are left out.
    """
    page = [key, "page"]
    rows = items.where("text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ITEMS))
    rows = rows.repartition(tasks, *page)  # a task sorts its items several times, so its share mustn't grow with the table
    if "width" in items.columns:
        right = F.col("x") + F.coalesce("width", F.lit(0.0))
        whole = Window.partitionBy(*page)
        wide = right - F.col("x") > WIDE * (F.max(right).over(whole) - F.min("x").over(whole))
        rows = rows.withColumn("_right", F.when(~wide, right)).withColumn("_order", F.when(wide, 1).otherwise(0))
        reach = F.max("_right").over(Window.partitionBy(*page).orderBy("x", "_order").rowsBetween(Window.unboundedPreceding, -1))
        fresh = (F.col("_right").isNotNull() & (F.col("x") > reach + gutter)).cast("int")
        rows = rows.withColumn("_fresh", F.coalesce(fresh, F.lit(0))).withColumn("column", F.sum("_fresh").over(Window.partitionBy(*page).orderBy("x", "_order")).cast("int"))
    else:
        rows = rows.withColumn("column", F.lit(0))
    down = Window.partitionBy(*page, "column").orderBy("y", "x")
    rows = rows.withColumn("_next", F.coalesce((F.col("y") - F.lag("y").over(down) > tolerance).cast("int"), F.lit(0))).withColumn("_at", F.sum("_next").over(down))
    found = rows.groupBy(*page, "column", "_at").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("x", "y", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda i: i["text"]), " ")
    found = found.withColumn("text", text).where(F.trim("text") != "")
    return found.select(*page, "column", F.row_number().over(Window.partitionBy(*page, "column").orderBy("_at")).alias("line"), "y", "text")


def readable(pages_of: DataFrame, key: str) -> DataFrame:
    """(key, chars, empty_share, readable): a scan has hardly any text, or mostly empty pages. pages_of: (key, page, text)."""
    size = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    rows = pages_of.groupBy(key, "page").agg(F.sum(size).alias("n")).groupBy(key)
    rows = rows.agg(F.sum("n").alias("chars"), F.avg((F.col("n") == 0).cast("double")).alias("empty_share"))
    return rows.withColumn("readable", (F.col("chars") >= MIN_EXTRACTED) & (F.col("empty_share") <= 0.5))


def write_results(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_history(entries: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Appends the allowed columns only: texts of descriptions never are."""
    entries.select(*columns).write.mode("append").parquet(path)


def delete_history(spark: SparkSession, path: str, target: str, key: str, deleted: DataFrame | None = None) -> None:
    """Writes the history at path to target without the entries whose key is among the deleted, or without any."""
    entries = spark.read.parquet(path)
    kept = entries.limit(0) if deleted is None else entries.join(deleted.select(key).distinct(), key, "left_anti")
    kept.write.mode("overwrite").parquet(target)


def pasted(lines_of: DataFrame, typed: DataFrame, key: str) -> DataFrame:
    """Lines (key, page, y, text) of documents, with what was pasted (key, text) instead for those that have it: the way round a document that can't be read."""
    own = typed.select(key, F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("y", "text")).where("trim(text) <> ''")
    return lines_of.join(typed.select(key).distinct(), key, "left_anti").select(key, "page", F.col("y").cast("double"), "text").unionByName(own.withColumn("y", F.col("y").cast("double")))


def session_store(df: DataFrame, name: str, withheld: Sequence[str] = ("description", "html")) -> DataFrame:
    """df without the withheld columns as a view of this session: kept in memory, never written."""
    kept = df.drop(*withheld).cache()
    kept.createOrReplaceTempView(name)
    return kept


def tokens(rows: DataFrame, key: str, code: str, names: Sequence[str]) -> DataFrame:
    """(key, nth, token) of the identifiers of code that are among the names."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(code), F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("nth", "token"))
    return found.where(F.col("token").isin(*names))


def uses(files: DataFrame) -> DataFrame:
    """(path, scan, line, text of the node) of both scans, `network` and `sync`, in one reading of the files (path, code)."""
    kind, name = F.col("kind"), F.col("name")
    network = kind.isin(IDENTIFIER, STRING) & name.isin(*NETWORK)
    sync = kind.isin(MEMBER, COMPUTED, BINDING) & (name == "sync")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # code is small to move and dear to read
    found = code_nodes(files.repartition(tasks, "path"), (*NETWORK, "sync")).withColumn("scan", F.when(network, "network").when(sync, "sync"))
    return found.where("scan IS NOT NULL").select("path", "scan", "line", "text")


def network_uses(files: DataFrame) -> DataFrame:
    """(path, line, text of the node) of files (path, code): names of the network interface, as any identifier or whole string."""
    return uses(files).where("scan = 'network'").drop("scan")


def sync_storage_uses(files: DataFrame) -> DataFrame:
    """(path, line, text of the node): members named `sync`, computed ones too, and bindings of that property, whatever holds it."""
    return uses(files).where("scan = 'sync'").drop("scan")


def violations(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws(" ", F.concat_ws(":", "path", F.col("line").cast("string")), "text").alias("violation"))


def host_allowed(pattern: Column, hosts: Sequence[str]) -> Column:
    """Whether a URL pattern names one of the hosts, without wildcards in the host."""
    host = F.regexp_extract(pattern, r"\A[a-z*]+://([^/]+)/", 1)
    return ~F.contains(host, F.lit("*")) & host.isin(*hosts)


def grants_access(pattern: Column, names: Sequence[str]) -> Column:
    """Whether a permission reaches a host that holds one of the names: all addresses, any host, or a host with the name in it."""
    host = F.regexp_extract(pattern, r"\A[a-z*]+://([^/]*)/", 1)
    named = F.lit(False)
    for name in names:
        named = named | F.contains(host, F.lit(name))
    return F.coalesce((pattern == "<all_urls>") | (host == "*") | named, F.lit(False))


def license_problems(packages: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(name, license) of shipped packages whose licence isn't allowed; packages: MAP name to (dev, license)."""
    rows = packages.select(F.explode("packages").alias("name", "p")).where(~F.coalesce(F.col("p.dev"), F.lit(False)))
    return rows.where(~F.coalesce(F.col("p.license").isin(*allowed), F.lit(False))).select("name", F.col("p.license").alias("license"))


def unlisted(packages: DataFrame, notices: DataFrame) -> DataFrame:
    return packages.join(notices, "name", "left_anti")


def latest_model(runs: DataFrame, key: str) -> DataFrame:
    """runs (key, at, model) with `changed`: the model isn't the run's before."""
    before = F.lag("model").over(Window.partitionBy(key).orderBy("at"))
    return runs.withColumn("changed", F.coalesce(F.col("model") != before, F.lit(False)))
