"""Pages as a stream: the record of each page as it arrives, and counts of refusals by window of arrival.

The reading of a page is a function of its row, so a stream runs it in micro-batches as it stands; only the counts keep state,
bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.text import document_title
from pagewright.functions.urls import guard, identity
from pagewright.plans.posting import extract

SCHEMA = "page_id long, url string, html string, at timestamp"


def pages(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def guarded(stream: DataFrame) -> DataFrame:
    """(page_id, at, ok, job_id, title), row by row."""
    own = guard(F.col("url"))
    return stream.select("page_id", "at", own.alias("ok"), F.when(own, identity(F.col("url"))["job_id"]).alias("job_id"), document_title(F.col("html")).alias("title"))


def counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, ok, pages): pages by window of arrival; what comes later than `late` isn't counted."""
    return guarded(stream).withWatermark("at", late).groupBy(F.window("at", width), "ok").agg(F.count("*").alias("pages"))


def write_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Extracts each micro-batch and writes it to a folder of its own: a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch.select("page_id", "url", "html")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
