"""The rollup as a stream's result: each batch merges its rows and notes what that changes.

The order of writes makes a batch count once, wherever it is cut off: first the delta of the buckets that it touches, while
they are as before; then the buckets; then a commit row. A batch that finds its delta written does not make
it again, as the buckets may have changed since; merging again changes nothing. Readers add up the committed deltas
behind the last compaction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from ..sources import buckets
from .scan import _read, is_committed


def _schema() -> str:
    kinds = {"slot": "timestamp_ntz"} | dict.fromkeys(rollup.KEYS[1:], "string") | dict.fromkeys(rollup.MEASURES, "long")
    return ", ".join(f"{c} {t}" for c, t in kinds.items())


def current(spark: SparkSession, base: str) -> DataFrame:
    """The rollup as of the last commit."""
    commits = _read(spark, f"{base}/commits")
    done = [] if commits is None else sorted(r.batch for r in commits.select("batch").distinct().collect())  # those since the last compaction, see ``compact``
    whole = _read(spark, f"{base}/compacted")
    last = -1 if whole is None else whole.agg(F.max("upto")).first()[0]
    parts = [spark.read.schema(_schema()).parquet(f"{base}/compacted/upto={last}")] if last >= 0 else []
    paths = [f"{base}/deltas/batch={b}" for b in done if b > last]
    if paths:
        parts.append(spark.read.schema(_schema()).parquet(*paths))
    return rollup.added(*(parts or [spark.createDataFrame([], _schema())]))


def compact(spark: SparkSession, base: str) -> None:
    """Write the rollup as of the last commit as one table, so that readers need no older deltas."""
    commits = _read(spark, f"{base}/commits")
    if commits is not None:
        last = commits.agg(F.max("batch")).first()[0]
        current(spark, base).write.mode("overwrite").parquet(f"{base}/compacted/upto={last}")


def sink(ledger: str, merge: buckets.Merge, base: str, after: Callable[[str], None] = lambda step: None, every: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of priced ledger rows into a bucketed ledger and the rollup under base; after is told of each step, every so many batches are compacted."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, base, number):
            return
        at = buckets.touched(batch)
        path = f"{base}/deltas/batch={number}"
        if _read(spark, f"{path}/_done") is None:
            stored = buckets.read(spark, ledger).where(F.col(buckets.BUCKET).isin(at)).drop(buckets.BUCKET)
            rollup.delta(stored, merge(stored, batch)).write.mode("overwrite").parquet(path)
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/_done")
        after("delta")
        buckets.merge_into(spark, ledger, batch, merge)
        after("ledger")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={number}")
        after("commit")
        if number % every == every - 1:
            compact(spark, base)

    return each
