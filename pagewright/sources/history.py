"""Histories from which entries can be deleted: partitioned by a hash of the key, so that a delete rewrites the partitions it touches and no others.

Every partition holds one row without an entry, so that it is rewritten, not left as it is, when its last entry goes. A partition
is replaced once its new files are complete. To delete again what is gone changes nothing, so a delete that was broken off is
repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(key: Column, buckets: int) -> Column:
    """The partition of a key: from the MD5 of its text, the same in any engine; null keys are in the first."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets, F.lit(0).cast("long")).cast("int")


def append(entries: DataFrame, path: str, columns: Sequence[str], key: str, buckets: int = BUCKETS) -> None:
    """Appends the allowed columns only; others, such as texts of descriptions, never reach the disk."""
    rows = entries.select(*columns).withColumn("live", F.lit(True)).withColumn("bucket", bucket(F.col(key), buckets))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _marks(rows: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """A row without an entry for each of the partitions, in the form of rows."""
    of = {"bucket": F.col("bucket"), "live": F.lit(False)}
    empty = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket int")
    return empty.select(*(of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def entries(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).where("live").drop("live", "bucket")


def touched(deleted: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """The partitions that hold the deleted keys: `buckets` numbers at most."""
    return sorted(r[0] for r in deleted.select(bucket(F.col(key), buckets)).distinct().collect())


def delete(spark: SparkSession, path: str, key: str, deleted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Deletes the entries whose key is among the deleted, and returns the partitions that were rewritten. A null key deletes entries without a key."""
    hit = touched(deleted, key, buckets)
    if not hit:
        return hit
    keys = deleted.select(F.col(key).alias("_key")).distinct()
    rows = _stored(spark, path).where(F.col("bucket").isin(*hit) & F.col("live"))
    kept = rows.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    written = kept.unionByName(_marks(rows, hit)).repartition("bucket")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return hit


def delete_all(spark: SparkSession, path: str) -> list[int]:
    """Deletes every entry, keys and all; the folder stays, without entries."""
    rows = _stored(spark, path)
    hit = sorted(r[0] for r in rows.select("bucket").distinct().collect())
    _marks(rows, hit).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return hit
