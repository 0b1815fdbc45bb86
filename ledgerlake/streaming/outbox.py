"""Delivery of pending rows and pulls of remote ones that neither skip nor repeat, wherever they are cut off.

One log for all tables: a push or pull of a table has a number, and what it is about is written down before it
starts: the rows that go out, or the high water up to which rows are read. It ends with a row in the log. A run that finds
a number begun and not ended goes on with what was written down: the same rows go out in the same numbered batches, which a
receiver knows by (account, number, batch), or the same stretch is read again, and merging it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from .scan import _read

Step = Callable[[str], None]
_LOG = "name string, way string, number long, rows long, high_water timestamp_ntz"


def log(spark: SparkSession, base: str) -> DataFrame:
    """(name, way, number, rows, high_water): a row for each push and pull that has ended."""
    found = _read(spark, f"{base}/log")
    return spark.createDataFrame([], _LOG) if found is None else spark.read.schema(_LOG).parquet(f"{base}/log")


def _last(spark: SparkSession, base: str, name: str, way: str):
    """Number and high water of the newest entry."""
    row = log(spark, base).where((F.col("name") == name) & (F.col("way") == way)).agg(F.max(F.struct("number", "high_water")).alias("m")).first().m
    return (0, None) if row is None else (row.number, row.high_water)


def _end(spark: SparkSession, base: str, name: str, way: str, number: int, rows: int, high: datetime | None) -> None:
    spark.createDataFrame([(rows, high)], "rows long, high_water timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{base}/log/name={name}/way={way}/number={number}")


def push(spark: SparkSession, base: str, name: str, read: Callable[[], DataFrame], send: Callable[[DataFrame], None], mark: Callable[[DataFrame], None], batch: int = 250, after: Step = lambda step: None) -> int:
    """Deliver the pending rows of a table (account_id, id, created_at, updated_at, sync_status, ...); returns how many.

    send gets rows with ``number`` and ``batch``, numbered within an account, and must take the same (account_id, number, batch) twice as once; mark gets the rows delivered.
    """
    number = _last(spark, base, name, "push")[0] + 1
    path = f"{base}/begun/{name}/push-{number}"
    if _read(spark, path) is None:
        pending(read(), batch).withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(path)
    after("begun")
    rows = spark.read.parquet(path)
    count = rows.count()
    if count:
        send(rows)
        after("sent")
        mark(rows)
        after("marked")
    _end(spark, base, name, "push", number, count, None)
    after("ended")
    return count


#: Parts among which an account's pending rows are numbered, so that no account is one task's work.
PARTS = 64


def pending(rows: DataFrame, batch: int = 250) -> DataFrame:
    """Pending rows of a table with ``batch``: within an account and part, oldest first; parts have batches of their own."""
    waiting = rows.where(F.col("sync_status").isin("pending", "error")).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    place = F.expr(f"(row_number() OVER (PARTITION BY account_id, _part ORDER BY created_at, id) - 1) div {batch}")
    return waiting.withColumn("batch", place * PARTS + F.col("_part")).drop("_part")


def pull(spark: SparkSession, base: str, name: str, remote: Callable[[], DataFrame], apply: Callable[[DataFrame], None], now: Callable[[], datetime], after: Step = lambda step: None) -> int:
    """Take a table's remote rows updated since the last pull; returns how many. The high water is written down before they are read, so rows that come meanwhile are left for the next."""
    last, since = _last(spark, base, name, "pull")
    number = last + 1
    path = f"{base}/begun/{name}/pull-{number}"
    if _read(spark, path) is None:
        spark.createDataFrame([(now(),)], "high_water timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(path)
    after("begun")
    high = spark.read.parquet(path).first().high_water
    stretch = merge.pulled(remote(), F.lit(since or datetime(1, 1, 1)).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
    count = stretch.count()
    if count:
        apply(stretch)
    after("applied")
    _end(spark, base, name, "pull", number, count, high)
    after("ended")
    return count


def report(spark: SparkSession, base: str) -> DataFrame:
    """(name, way, runs, rows, high_water) of each table: what was sent and taken in all."""
    return log(spark, base).groupBy("name", "way").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"), F.max("high_water").alias("high_water"))
