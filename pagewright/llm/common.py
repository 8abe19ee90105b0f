"""What several operators share: shared-folder tables, bounded Arrow batches, deterministic samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only in local mode, where all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_mod(doc_id, mod: int):
    """crc32 of doc_id written as text, modulo mod: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def hash_share(key: str, share):
    """Whether the hash of key is among the least `share` (a number or a column) of all hashes."""
    return F.xxhash64(key).cast("double") / F.lit(2.0**64) + 0.5 < share


def ample(n: int, rows):
    """A share of the rows that holds n of them by six standard deviations."""
    return (n + 6 * n**0.5 + 50) / F.greatest(F.lit(1), rows)


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """A sample of at most n distinct values of key that doesn't depend on the partitioning: those with the smallest hashes.

    The rows are counted first, and only hashes that may be among the n smallest are told apart and sorted: else all keys would
    be shuffled. Where keys repeat, as many fewer may be found.
    """
    rows = df.where(hash_share(key, ample(n, F.lit(df.count())))).select(key).distinct()
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
