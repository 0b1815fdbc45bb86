"""Scanning session logs as a stream: rows, diagnostics and manifest of a batch count together or not at all.

A batch writes its parts to folders of its own number and then one commit row. What has no commit row is not
read (``committed``); a batch that was cut off writes its folders anew, one that is committed is not run again. If a
ledger is given, the batch is merged into it before the commit; a merge that runs twice changes nothing more.
A file that changed is read whole, so its rows come again in a later batch: merges know them by id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import buckets, logs
from ..sources.logstream import LogSource

#: Parts of a batch.
PARTS = ("rows", "diagnostics", "manifest", "tallies")
Collect = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def lines(spark: SparkSession, roots: str, listings: str, pattern: str = "*.jsonl", parser: int = 1, split_bytes: int | None = None) -> DataFrame:
    """The stream of lines of new and changed logs; roots is a JSON list of folders."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format("session_logs").options(roots=roots, listings=listings, pattern=pattern, parser=parser)
    return (reader if split_bytes is None else reader.option("splitBytes", split_bytes)).load()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_committed(spark: SparkSession, base: str, batch: int) -> bool:
    commits = _read(spark, f"{base}/commits")
    return commits is not None and bool(commits.where(F.col("batch") == batch).take(1))


def committed(spark: SparkSession, base: str, part: str) -> DataFrame:
    """A part of all committed batches, with the number of the batch."""
    rows, commits = spark.read.parquet(f"{base}/{part}"), spark.read.parquet(f"{base}/commits").select("batch")
    return rows.join(F.broadcast(commits), "batch", "left_semi")  # a number for each batch; folders of others are pruned


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest entry of each file."""
    newest = Window.partitionBy("source_key").orderBy(F.desc("batch"))
    return committed(spark, base, "manifest").withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch")


def current_rows(spark: SparkSession, base: str) -> DataFrame:
    """The rows of each file as it was read last."""
    rows = committed(spark, base, "rows")
    last = committed(spark, base, "manifest").groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").drop("batch")


def sink(
    collect: Collect, provider: str, parser: int, base: str, now: Callable[[], datetime], ledger: tuple[str, buckets.Merge, Callable[[DataFrame], DataFrame]] | None = None, after: Callable[[str], None] = lambda step: None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of ``lines``. ledger: a table of ``buckets``, how to merge into it, and what makes ledger rows of a log's rows. after is told of each step."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, base, number):
            return
        events, found = collect(batch)
        _put(events, base, "rows", number)
        after("rows")
        _put(found, base, "diagnostics", number)
        after("diagnostics")
        rows, odd = (spark.read.schema(df.schema).parquet(f"{base}/{part}/batch={number}") for df, part in ((events, "rows"), (found, "diagnostics")))
        listing = batch.groupBy("path").agg(F.max("size").alias("size"), F.max("modified").alias("modified"))
        entries = logs.entries(listing, rows, odd, provider, parser, now())
        _put(entries.join(listing.select("path", F.concat(F.lit(f"{provider}:"), F.sha2("path", 256)).alias("source_key")), "source_key"), base, "manifest", number)
        _put(logs.tally(batch, rows, odd).withColumn("provider", F.lit(provider)), base, "tallies", number)
        after("manifest")
        if ledger is not None:
            path, merge, ledger_rows = ledger
            buckets.merge_into(spark, path, ledger_rows(rows), merge)
            after("ledger")
        spark.createDataFrame([(now(),)], "committed_at timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={number}")
        after("commit")

    return each


def _put(rows: DataFrame, base: str, part: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{base}/{part}/batch={number}")
