"""Tables in buckets, of which a merge reads and writes those that its batch touches.

A row's bucket is a hash of its account and of what never changes about it: a usage row's provider and
session, another row's id. As the sessions of a batch are few, so are its buckets, whatever the table's size. A
merge finds them first (at most as many numbers as there are buckets), reads just their folders, and overwrites
them by Spark's dynamic partition overwrite: all files are written before any is replaced. Replacing
is by folder, not at once for all; a merge that was cut off there is repaired by running it again, as
merging a batch twice gives what merging it once gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table; fixed when it is first written. A folder should hold some 100 MB to 1 GB.
BUCKETS = 64
BUCKET = "bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def home(columns: list[str]) -> list[str]:
    """The columns whose hash is the bucket: rows that a merge brings together agree in them."""
    keys = ["provider", "native_session_id"] if "native_session_id" in columns else ["device_id", "model_id"] if "model_id" in columns else ["id"]
    return [c for c in ("account_id", *keys) if c in columns]


def bucket_of(columns: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*home(columns)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int, mode: str) -> None:
    placed = rows.withColumn(BUCKET, bucket_of(rows.columns, buckets))
    # Rebalanced, so a bucket of many rows is written as several files.
    dealt = placed.hint("rebalance", F.col(BUCKET))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new table of rows; it must not exist."""
    _write(rows, path, buckets, "errorifexists")


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table's rows and their bucket, by which scans are pruned."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def touched(batch: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that hold, or would hold, rows of a batch."""
    return sorted(r[0] for r in batch.select(bucket_of(batch.columns, buckets)).distinct().collect())  # at most ``buckets`` numbers


def merge_into(spark: SparkSession, path: str, batch: DataFrame, merge: Merge, buckets: int = BUCKETS) -> list[int]:
    """Replace the buckets that batch touches by merge(their rows, batch); the others are neither read nor written. Returns the buckets."""
    at = touched(batch, buckets)
    if at:
        stored = read(spark, path)
        schema = stored.drop(BUCKET).schema
        some = spark.read.schema(stored.schema).parquet(path).where(F.col(BUCKET).isin(at)).drop(BUCKET)
        _write(merge(some, batch).select(*schema.names), path, buckets, "overwrite")
    return at
