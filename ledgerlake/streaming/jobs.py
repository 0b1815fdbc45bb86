"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import hashed
from ..operators import merge
from ..operators.runtime import STALE_SECONDS


def quota_buckets(readings: DataFrame) -> DataFrame:
    """The last reading of each window in every five minutes (update mode)."""
    keys = [F.window("observed_at", "5 minutes"), "provider", "window_key", "device_id", "period_starts_at", "resets_at"]
    last = readings.withWatermark("observed_at", "1 hour").groupBy(*keys).agg(F.max_by("utilization_bps", "observed_at").alias("utilization_bps"), F.max("observed_at").alias("observed_at"))
    return last.select(F.col("window.start").alias("bucket"), "provider", "window_key", "device_id", "utilization_bps", "observed_at")


def activity_minutes(samples: DataFrame, sources: list[str]) -> DataFrame:
    """Samples (source, device_id, minute, ingested_at) within five minutes of their arrival, one for each minute."""
    arrived = F.expr("CAST(unix_timestamp(ingested_at) AS BIGINT) div 60")
    near = samples.where(F.col("source").isin(*sources) & (F.abs(F.col("minute") - arrived) <= 5))
    keyed = near.withColumns({"occurred_at": F.timestamp_seconds(F.col("minute") * 60), "id": hashed(F.lit("activity"), F.concat("source", F.lit(":"), "device_id"), F.concat(F.lit("minute:"), "minute"))})
    return keyed.withWatermark("occurred_at", "5 minutes").dropDuplicatesWithinWatermark(["id"]).select("id", "source", "device_id", "minute", "occurred_at")


_OUT = "device_id string, provider string, observed_at timestamp, state string, model string"
_STATE = "observed_at timestamp, status string, loaded array<string>"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Transitions of one runtime; the state is its last poll."""
    at, status, loaded = state.get if state.exists else (None, None, [])
    out = []
    for row in pd.concat(list(batches)).sort_values("observed_at").itertuples(index=False):
        healthy = row.status == "healthy"
        listed = row.models if healthy and row.models is not None else []
        now, may_be = [m["id"] for m in listed if m["loaded"]], [m["id"] for m in listed if m["loaded"] is None or m["loaded"]]
        fresh = status == "healthy" and (row.observed_at - pd.Timestamp(at)).total_seconds() <= STALE_SECONDS
        if healthy and not fresh:
            out.append((*key, row.observed_at, "server_online", None))
        if fresh and row.status == "unavailable":
            out.append((*key, row.observed_at, "server_unavailable", None))
        if healthy:
            out += [(*key, row.observed_at, "model_loaded", m) for m in now if m not in loaded]
            out += [(*key, row.observed_at, "model_unloaded", m) for m in loaded if m not in may_be]
        at, status, loaded = row.observed_at, row.status, now
    state.update((at, status, list(loaded)))
    yield pd.DataFrame(out, columns=["device_id", "provider", "observed_at", "state", "model"])


def transitions(polls: DataFrame) -> DataFrame:
    """The stream of ``operators.runtime.transitions``: one poll of state for each runtime (append mode)."""
    return polls.groupBy("device_id", "provider").applyInPandasWithState(_changes, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_merge(read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges hourly counters into a stored table; late hours are welcome, so there is no watermark."""

    def each(batch: DataFrame, _: int) -> None:
        write(merge.merge_hourly(read(), batch))

    return each
