"""The stream of runtimes' states equals its batch form, and grows stale by itself."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.streaming import runtimes

AT = datetime(2026, 9, 1, 12)
POLL = "device_id string, provider string, observed_at timestamp_ntz, status string, models array<struct<id:string,loaded:boolean>>"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(spark, folder, check, batches):
    """The stream over files that come one by one, each a run of its own from the same checkpoint."""
    found = []
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, POLL).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = runtimes.states(spark.readStream.schema(rows.schema).parquet(folder))
        keep = lambda df, _: found.extend(tuple(r) for r in df.collect())
        stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return found


def _poll(device, s, status, *models):
    return (device, "omlx", AT + timedelta(seconds=s), status, [(m[0], {"+": True, "-": False}.get(m[1:])) for m in models])


def test_stale_without_a_further_poll(rocks, tmp_path):
    batches = [[_poll("a", 0, "healthy", "m+"), _poll("b", 0, "healthy", "m+")], [_poll("b", 100, "healthy", "m+")], [_poll("b", 200, "healthy", "m+")], [_poll("b", 300, "unavailable")], [_poll("a", 400, "healthy", "m+", "n")]]
    found = [(r[0], int((r[2] - AT).total_seconds()), r[3], r[4]) for r in _run(rocks, f"{tmp_path}/polls", f"{tmp_path}/check", batches)]
    assert ("a", 120, "server_stale", None) in found and [x for x in found if x[2] == "server_stale"] == [("a", 120, "server_stale", None)]
    assert found.index(("a", 120, "server_stale", None)) < found.index(("a", 400, "server_online", None))
    assert sorted(found, key=str) == sorted([
        ("a", 0, "server_online", None), ("a", 0, "model_loaded", "m"), ("a", 0, "model_seen", "m"), ("b", 0, "server_online", None), ("b", 0, "model_loaded", "m"), ("b", 0, "model_seen", "m"), ("a", 120, "server_stale", None),
        ("b", 300, "server_unavailable", None), ("a", 400, "server_online", None), ("a", 400, "model_seen", "n")], key=str)


def test_stream_equals_the_batch_form(rocks, tmp_path):
    rng = random.Random(3)
    polls, at = [], 0
    for _ in range(60):
        at += rng.choice([30, 60, 119, 120, 121, 400])
        for device in "ab":
            models = [f"{m}{rng.choice('+-?')}" for m in "mno" if rng.random() < 0.6]
            polls.append(_poll(device, at + (device == "b"), rng.choice(["healthy", "healthy", "healthy", "unavailable", "not_detected"]), *models))
    cuts = [0, 13, 40, 41, 90, len(polls)]
    found = sorted(map(str, _run(rocks, f"{tmp_path}/polls", f"{tmp_path}/check", [polls[a:b] for a, b in zip(cuts, cuts[1:])])))
    table = rocks.createDataFrame(polls, POLL)
    end = max(p[2] for p in polls)
    wanted = runtimes.batch_states(table, end).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    assert found == sorted(str(tuple(r)) for r in wanted.collect()) and len(found) > 100
