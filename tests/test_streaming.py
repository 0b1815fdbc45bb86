"""Streams give what their batch forms give."""

from pyspark.sql import functions as F

from ledgerlake.operators import runtime
from ledgerlake.sources import derived
from ledgerlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def _run(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_transitions_equal_the_batch_form(spark, tmp_path):
    polls = derived.polls(spark, SF).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    polls.repartition(1).sortWithinPartitions("observed_at").write.parquet(f"{tmp_path}/polls")
    stream = jobs.transitions(spark.readStream.schema(polls.schema).parquet(f"{tmp_path}/polls"))
    found = {tuple(r) for r in _run(spark, stream, "transitions", "append").collect()}
    wanted = {tuple(r) for r in runtime.transitions(derived.polls(spark, SF)).withColumn("observed_at", F.col("observed_at").cast("timestamp")).collect()}
    assert found == wanted and found


def test_minutes_are_counted_once_and_in_time(spark, tmp_path):
    rows = [("grok_web", "d", 100, 100 * 60), ("grok_web", "d", 100, 101 * 60), ("grok_web", "d", 101, 120 * 60), ("other", "d", 100, 100 * 60), ("grok_web", "e", 100, 95 * 60)]
    samples = spark.createDataFrame(rows, "source string, device_id string, minute long, s long").select("source", "device_id", "minute", F.timestamp_seconds("s").alias("ingested_at"))
    samples.write.parquet(f"{tmp_path}/samples")
    stream = jobs.activity_minutes(spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/samples"), ["grok_web"])
    assert sorted((r.device_id, r.minute) for r in _run(spark, stream, "minutes", "append").collect()) == [("d", 100), ("e", 100)]


def test_quota_buckets_keep_the_last_reading(spark, tmp_path):
    readings = derived.quota_readings(spark, SF).where("w < 4").withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "period_starts_at", "resets_at")})
    readings.write.parquet(f"{tmp_path}/readings")
    stream = jobs.quota_buckets(spark.readStream.schema(readings.schema).parquet(f"{tmp_path}/readings"))
    found = _run(spark, stream, "buckets", "update").groupBy("bucket", "window_key", "device_id").agg(F.max("observed_at").alias("o")).count()
    wanted = readings.select(F.window("observed_at", "5 minutes"), "window_key", "device_id").distinct().count()
    assert found == wanted
