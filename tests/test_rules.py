"""Rules of merges, quota windows and runtimes at their edges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns
from ledgerlake.operators import merge, quota, reconcile, runtime
from ledgerlake.sources import responses

from .test_operators import AT, _series, event, ledger

DAY = timedelta(days=1)


def _by_id(df):
    return {r.id[-1]: r for r in df.collect()}


def test_revisions_of_superseded_rows_and_other_identities_are_refused(spark):
    stored = ledger(spark, event(1, total_tokens=10, superseded_by_event_id="x"), event(2, total_tokens=10), event(3, total_tokens=10, created_at=AT - DAY))
    new = ledger(spark, event(1, total_tokens=99), event(2, total_tokens=99, device_id="z"), event(2, total_tokens=50, source="other"), event(3, total_tokens=99, created_at=AT + DAY), event(4))
    rows = _by_id(merge.upsert_revisions(stored, new))
    assert [(k, rows[k].total_tokens, rows[k].superseded_by_event_id, rows[k].device_id, rows[k].sync_status) for k in "1234"] == [
        ("1", 10, "x", "d", "synced"), ("2", 10, None, "d", "synced"), ("3", 99, None, "d", "pending"), ("4", 0, None, "d", "pending")]
    assert rows["3"].created_at == AT - DAY
    fine, refused = merge.guarded(stored, new, {"tiny": F.col("total_tokens") < 0})
    assert sorted(r.id[-1] for r in fine.collect()) == ["3", "4"]
    assert sorted((r.id[-1], tuple(r.refused)) for r in refused.collect()) == [("1", ("superseded",)), ("2", ("other_identity",)), ("2", ("other_identity",))]
    other = ledger(spark, event(1, account_id="b", device_id="q"))
    assert merge.guarded(stored, other, {})[1].count() == 0 and reconcile.identity_conflicts(stored, new).count() == 3


def test_cache_writes_are_raised_inserted_and_priced(spark):
    now = AT + DAY
    stored = ledger(spark, event(1, cache_write_tokens=5), event(2, cache_write_tokens=5, superseded_by_event_id="x"), event(3, cache_write_tokens=5, updated_at=now + DAY), event(4, cache_write_tokens=5))
    priced = {"estimated_api_value_usd_micros": 7, "pricing_status": "available", "model": "z", "total_tokens": 77}
    new = ledger(spark, event(1, cache_write_tokens=8, **priced), event(1, cache_write_tokens=9, device_id="q", **priced), event(2, cache_write_tokens=8, **priced), event(3, cache_write_tokens=8, **priced), event(4, cache_write_tokens=5, **priced), event(5, cache_write_tokens=1))
    rows = _by_id(merge.raise_cache_write(stored, new, now))
    assert [(k, r.cache_write_tokens, r.estimated_api_value_usd_micros, r.pricing_status, r.model, r.total_tokens, r.sync_status) for k, r in sorted(rows.items())] == [
        ("1", 8, 7, "available", "gpt-5.6-sol", 0, "pending"), ("2", 5, None, "unavailable", "gpt-5.6-sol", 0, "synced"), ("3", 8, 7, "available", "gpt-5.6-sol", 0, "pending"),
        ("4", 5, None, "unavailable", "gpt-5.6-sol", 0, "synced"), ("5", 1, None, "unavailable", "gpt-5.6-sol", 0, "synced")]
    assert (rows["1"].updated_at, rows["3"].updated_at, rows["4"].updated_at) == (now, now + DAY + timedelta(microseconds=1), AT)


def test_hourly_rows_of_one_batch(spark):
    schema = "device_id string, model_id string, hour long, prompt_tokens long, completion_tokens long, cached_tokens long, requests long"
    rows = lambda *counters: spark.createDataFrame([("d", "m", 1, *c, 1) for c in counters], schema)
    found = merge.merge_hourly(rows((10, 10, 5)), rows((20, 5, 5), (15, 15, 6))).first()
    assert tuple(found)[3:6] == (15, 15, 6)
    assert tuple(merge.merge_hourly(rows((10, 10, 5)), rows((20, 5, 5), (9, 99, 9))).first())[3:6] == (10, 10, 5)


def test_only_the_accounts_own_rows_are_acknowledged(spark):
    rows = ledger(spark, event(1, sync_status="pending"), event(1, account_id="b", sync_status="pending"), event(2, sync_status="pending", updated_at=AT + DAY))
    sent = ledger(spark, event(1), event(2))
    assert sorted((r.account_id, r.id[-1], r.sync_status) for r in merge.acknowledged(rows, sent).collect()) == [("a", "1", "synced"), ("a", "2", "pending"), ("b", "1", "pending")]
    assert merge.acknowledged(rows, sent.select("account_id", "id")).where("sync_status = 'synced'").count() == 2


def test_accounts_supersede_their_own_rows(spark):
    rows = ledger(spark, event(1), event(1, account_id="b"))
    pairs = spark.createDataFrame([("b", event(1)["id"], "new")], "account_id string, legacy_event_id string, replacement_event_id string")
    assert {(r.account_id, r.superseded_by_event_id) for r in reconcile.superseded(rows, pairs, AT).collect()} == {("a", None), ("b", "new")}


def test_weekly_windows_of_models_bear_a_cap(spark):
    readings, window = _series(spark, [(0, 500), (30, 3000), (70, 6000), (95, 8000)])
    for kind, status in (("weekly", "active"), ("model_weekly", "active"), ("product", "informational")):
        row = quota.pace(readings, window.withColumn("kind", F.lit(kind))).first()
        assert (row.status, row.projected_full_at is not None) == (status, status == "active")
    assert quota.at_risk(quota.pace(readings, window.withColumn("kind", F.lit("model_weekly")))).count() == 1
    no_reset = window.withColumns({"kind": F.lit("model_weekly"), "resets_at": F.lit(None).cast("timestamp_ntz")})
    slow = readings.withColumns({"utilization_bps": F.expr("100 + cast(utilization_bps / 500 as long)"), "resets_at": F.lit(None).cast("timestamp_ntz")})
    assert quota.pace(slow, no_reset.withColumn("utilization_bps", F.lit(116).cast("long"))).first().projected_full_at is None  # beyond 8 days


def test_windows_grow_stale_after_900_seconds(spark):
    readings, window = _series(spark, [(0, 500), (30, 3000), (70, 6000), (95, 8000)])
    at = window.first().observed_at
    for seconds, stale in ((0, False), (900, False), (901, True), (-5, False)):
        row = quota.pace(readings, window, F.lit(at + timedelta(seconds=seconds)).cast("timestamp_ntz")).first()
        assert (row.stale, row.status, row.projected_full_at is None) == (stale, "stale" if stale else "active", stale)


def test_no_projection_of_no_time(spark):
    readings, window = _series(spark, [(0, 1), (20, 5000), (40, 9999)])
    row = quota.pace(readings, window.withColumn("utilization_bps", F.lit(9999).cast("long"))).first()
    assert row.burn_bps_per_hour > 3600 and row.projected_full_at is None


POLL = "device_id string, provider string, observed_at timestamp_ntz, status string, models array<struct<id:string,loaded:boolean>>"


def _polls(spark, *rows):
    return spark.createDataFrame([("d", "omlx", AT + timedelta(seconds=s), status, [(m, True) for m in models]) for s, status, *models in rows], POLL)


def test_models_that_came_back_are_first_seen_again(spark):
    polls = _polls(spark, (0, "healthy", "m", "n"), (60, "unavailable"), (120, "healthy", "m"), (180, "healthy", "m", "n"), (240, "not_detected"), (300, "healthy", "n"))
    found = {r.model: ((r.first_seen - AT).seconds, (r.last_seen - AT).seconds) for r in runtime.first_seen(polls).collect()}
    assert found == {"m": (0, 180), "n": (300, 300)}
    assert sorted((r.model, (r.first_seen - AT).seconds, (r.last_seen - AT).seconds) for r in runtime.sightings(polls).collect()) == [("m", 0, 180), ("n", 0, 0), ("n", 180, 180), ("n", 300, 300)]


def test_old_and_disabled_runtimes_are_not_reachable(spark):
    polls = _polls(spark, (0, "unavailable"), (60, "healthy", "m", "n"))
    at = lambda s: F.lit(AT + timedelta(seconds=s)).cast("timestamp_ntz")
    for s, n in ((60, 1), (180, 1), (181, 0), (59, 0), (10**9, 0)):
        assert tuple(runtime.counts(polls, at(s)).first()) == ("d", n, 2 * n)
    off = spark.createDataFrame([("d", "omlx", False)], "device_id string, provider string, enabled boolean")
    assert tuple(runtime.counts(polls, at(60), off).first()) == ("d", 0, 0)


def test_devices_from_elsewhere(spark):
    schema = "device_id string, friendly_name string, updated_at timestamp_ntz"
    stored = spark.createDataFrame([("own", "Mine", AT), ("x", "Old", AT), ("y", "Kept", AT)], schema)
    remote = spark.createDataFrame([("own", "Theirs", AT + DAY), ("x", "New", AT + DAY), ("y", "Older", AT), ("z", None, AT)], schema)
    assert {r.device_id: r.friendly_name for r in merge.apply_remote_devices(stored, remote, "own").collect()} == {"own": "Mine", "x": "New", "y": "Kept", "z": "Unnamed device"}


def test_running_models_win(spark):
    body = '{"models": [{"name": "a", "size": 5}, {"name": "b"}]}'
    running = '{"models": [{"name": "b", "size_vram": 7}, {"name": "c"}]}'
    frame = lambda text: spark.createDataFrame([("r", "ollama", text, AT)], "response_id string, provider string, body string, received_at timestamp_ntz")
    found = responses.with_running(responses.models(frame(body)), responses.models(frame(running)))
    assert {r.model for r in found.collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("name, label", [("  Desk \x07 top ", "Desk  top"), ("", None), ("x" * 100, "x" * 80), (None, None)])
def test_labels(spark, name, label):
    assert spark.createDataFrame([(name,)], "n string").select(columns.device_label(F.col("n"))).first()[0] == label


def test_diagnostics_are_cut_by_provider(spark):
    found = spark.createDataFrame([("p", "f", i, "c", "warning") for i in range(30)] + [("q", "f", 1, "c", "error")], "provider string, path string, line long, code string, severity string")
    assert reconcile.first_diagnostics(found).groupBy("provider").count().orderBy("provider").collect() == [("p", 20), ("q", 1)]
    assert datetime(2026, 1, 1) < AT
