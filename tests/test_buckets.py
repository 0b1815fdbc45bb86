"""Merges of bucketed tables: equal to merges of whole tables, other buckets untouched."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import merge
from ledgerlake.sources import buckets, derived
from ledgerlake.sources.ledger import ledger

SF = "/root/testdata/sf0.001"


def _files(path):
    return {p.relative_to(path).as_posix(): (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in Path(path).rglob("*.parquet")}


def _rows(df):
    return sorted(map(str, df.drop(buckets.BUCKET).collect()))


def _some_sessions(rows, n):
    return rows.where(F.pmod(F.xxhash64("native_session_id"), F.lit(n)) == 0)


def _insert(stored):
    return _some_sessions(stored.withColumns({"native_event_id": F.concat("native_event_id", F.lit("x")), "id": F.sha2(F.concat("id", F.lit("x")), 256)}), 40).unionByName(_some_sessions(stored, 40))


def _remote(stored):
    return _some_sessions(stored, 40).withColumns({"total_tokens": F.col("total_tokens") + 1, "updated_at": F.expr("updated_at + make_dt_interval(total_tokens % 3 - 1)")})


@pytest.mark.parametrize("name, batch_of", [("insert_absent", _insert), ("upsert_revisions", _remote), ("apply_remote", _remote)])
def test_a_merge_touches_its_buckets_only(spark, tmp_path, name, batch_of):
    path, stored = f"{tmp_path}/ledger", ledger(spark, SF)
    buckets.create(stored, path)
    before, batch = _files(path), batch_of(stored)
    wanted = _rows(getattr(merge, name)(stored, batch))
    at = buckets.merge_into(spark, path, batch, getattr(merge, name))
    after = _files(path)
    assert 0 < len(at) < len(buckets.touched(stored))
    inside = {f"{buckets.BUCKET}={b}" for b in at}
    assert {f: x for f, x in before.items() if f.split("/")[0] not in inside} == {f: x for f, x in after.items() if f.split("/")[0] not in inside}
    assert all(f not in after for f in before if f.split("/")[0] in inside)
    assert _rows(buckets.read(spark, path)) == wanted
    buckets.merge_into(spark, path, batch, getattr(merge, name))  # again, as after a merge that was cut off
    if name == "insert_absent":
        assert _rows(buckets.read(spark, path)) == wanted
    scan = buckets.read(spark, path).where(F.col(buckets.BUCKET).isin(at))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in scan or "PartitionFilters: [isnotnull(bucket" in scan


def test_hourly_counters_and_empty_batches(spark, tmp_path):
    rows = [("d", f"m{i}", h, 10 * h, 5, 1, 2) for i in range(20) for h in range(3)]
    schema = "device_id string, model_id string, hour long, prompt_tokens long, completion_tokens long, cached_tokens long, requests long"
    stored = spark.createDataFrame(rows, schema)
    batch = spark.createDataFrame([("d", "m3", 1, 99, 9, 9, 9), ("d", "new", 1, 1, 1, 1, 1), ("d", "m4", 2, 1, 1, 1, 7)], schema)
    path = f"{tmp_path}/hours"
    buckets.create(stored, path)
    wanted = _rows(merge.merge_hourly(stored, batch))
    assert len(buckets.merge_into(spark, path, batch, merge.merge_hourly)) <= 3
    assert _rows(buckets.read(spark, path)) == wanted
    before = _files(path)
    assert buckets.merge_into(spark, path, batch.limit(0), merge.merge_hourly) == []
    assert _files(path) == before


def test_a_cut_off_merge_leaves_the_table(spark, tmp_path):
    path, stored = f"{tmp_path}/ledger", ledger(spark, SF)
    buckets.create(stored, path)
    before = _files(path)

    def broken(some, batch):
        return merge.insert_absent(some, batch).withColumn("total_tokens", F.expr("if(total_tokens >= 0, raise_error('lost'), total_tokens)").cast("long"))

    with pytest.raises(Exception, match="lost"):
        buckets.merge_into(spark, path, _insert(stored), broken)
    assert _files(path) == before
    assert derived.revisions(spark, SF).count() > 0
