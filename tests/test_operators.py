"""Golden values of pricing, cache, sessions, quota and merges."""

from datetime import datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns, ranges
from ledgerlake.operators import cache, merge, pricing, quota, reconcile, runtime, sessions
from ledgerlake.sources import catalogue
from ledgerlake.sources.ledger import COUNTERS, LEDGER_SCHEMA

AT = datetime(2026, 9, 1, 12)
DEVICES = "device_id string, friendly_name string"


def event(n, **fields):
    base = {"id": f"{n:064d}", "account_id": "a", "provider": "codex", "source": "codex_cli", "source_type": "local_cli", "native_session_id": "s", "native_event_id": f"e{n}", "occurred_at": AT, "model": "gpt-5.6-sol", "project_name": None}
    base |= dict.fromkeys(COUNTERS, 0) | {"estimated_api_value_usd_micros": None, "native_cost_usd_ticks": None, "pricing_status": "unavailable", "measurement_kind": "measured", "device_id": "d", "created_at": AT, "updated_at": AT, "superseded_by_event_id": None, "sync_status": "synced"}
    return base | fields


def ledger(spark, *events):
    names = [x.split()[0] for x in LEDGER_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], LEDGER_SCHEMA)


CLAUDE = {"provider": "claude", "source": "claude_code", "model": "claude-haiku-4-5-20251001"}


@pytest.mark.parametrize(
    "fields, value, status",
    [
        ({"input_tokens": 200_000, "cached_input_tokens": 100_000, "output_tokens": 100_000}, 400_000 + 40_000 + 2_000_000, "available"),
        ({"input_tokens": 1_000_000}, 8_000_000, "available"),  # long tier
        ({"input_tokens": 1_000_000, "occurred_at": datetime(2026, 8, 20)}, 10_000_000, "available"),  # older price
        ({"input_tokens": 1000, "cache_write_tokens": 10}, 990 * 4, "partial"),  # no write rate
        (CLAUDE | {"input_tokens": 50_000, "cached_input_tokens": 50_000, "cache_write_tokens": 50_000, "cache_write_5m_tokens": 25_000, "cache_write_1h_tokens": 25_000}, 50_000 + 5_000 + 31_250 + 50_000, "available"),
        (CLAUDE | {"input_tokens": 200_001}, None, "unavailable"),  # outside its tiers
        ({"model": None, "input_tokens": 5}, None, "unavailable"),
        ({"model": "gpt-5.6-other", "input_tokens": 5}, None, "unavailable"),  # the exact pattern matches no longer name
    ],
)
def test_value_of_an_event(spark, fields, value, status):
    row = pricing.priced(ledger(spark, event(1, **fields)), catalogue.rules(spark)).first()
    assert (row.estimated_api_value_usd_micros, row.pricing_status) == (value, status)


def test_catalogue_has_39_rules(spark):
    assert catalogue.validated(catalogue.rules(spark)).count() == len(catalogue.rule_rows()) == 39


def test_reprice_gives_changed_rows_only(spark):
    rules = catalogue.rules(spark)
    priced = pricing.priced(ledger(spark, event(1, input_tokens=9), event(2, model=None)), rules)
    assert pricing.repriced(priced, rules).count() == 0
    assert pricing.repriced(ledger(spark, event(1, input_tokens=9), event(2, model=None)), rules).count() == 1


def test_cache_report_mixes_semantics(spark):
    rows = ledger(spark, event(1, input_tokens=1000, cached_input_tokens=700, cache_write_tokens=0), event(2, **CLAUDE, input_tokens=100, cached_input_tokens=700, cache_write_tokens=200), event(3, provider="x", source="y", input_tokens=5))
    total = cache.report(rows, catalogue.rules(spark), None).where("dimension = 'total'").first()
    assert (total.fresh_input_tokens, total.input_context_tokens, total.reuse_bps, total.semantic_coverage, total.unspecified_write_tokens) == (400, 2000, 7000, "partial", 200)


def test_session_totals_reach_before_the_range(spark):
    rows = ledger(spark, event(1, occurred_at=AT - timedelta(days=2), total_tokens=1_000_000, project_name="p"), event(2, total_tokens=400_000, model="claude opus"), event(3, source="omlx_usage_hourly", total_tokens=5))
    devices = spark.createDataFrame([("d", "Desk")], DEVICES)
    one = sessions.sessions(rows, devices, AT - timedelta(hours=1), search="OPUS").first()
    assert (one.total_tokens, one.events, one.project, one.model, one.models, one.duration_seconds) == (1_400_000, 2, "p", "gpt-5.6-sol", 2, 172_800)
    assert sessions.sessions(rows, devices, AT + timedelta(hours=1)).count() == 0


def _series(spark, points, period=True):
    start = datetime(2026, 9, 1)
    rows = [("claude", "w", "d", start + timedelta(minutes=m), start + timedelta(minutes=m), bps, start if period else None, start + timedelta(days=7) if period else None) for m, bps in points]
    readings = spark.createDataFrame(rows, "provider string, window_key string, device_id string, observed_at timestamp_ntz, updated_at timestamp_ntz, utilization_bps long, period_starts_at timestamp_ntz, resets_at timestamp_ntz")
    last = readings.orderBy(F.desc("observed_at")).limit(1)
    return readings, last.withColumns({"kind": F.lit("weekly"), "refresh_stale": F.lit(False)})


@pytest.mark.parametrize(
    "points, kept, confidence",
    [
        ([(0, 700), (25, 1500), (70, 4100)], 3, "low"),
        ([(0, 8000), (12, 8300), (24, 300), (41, 520), (66, 900)], 3, "low"),  # a reset between 12 and 24
        ([(0, 150), (6, 340)], 2, "insufficient"),
        ([(11 * i, 37 * i * i) for i in range(8)], 6, "medium"),  # the last hour alone
        ([(10 * i, 37 * i * i - 20 * (i == 3)) for i in range(7)], 7, "high"),
    ],
)
def test_quota_pace(spark, points, kept, confidence):
    row = quota.pace(*_series(spark, points)).first()
    part, high = [], 0
    for m, bps in points[-kept:]:
        high = max(high, bps)
        part.append((m, high))
    slopes = sorted((q - p) * 60 // (n - m) for i, (m, p) in enumerate(part) for n, q in part[i + 1 :])
    middle = slopes[len(slopes) // 2] if len(slopes) % 2 else (slopes[len(slopes) // 2 - 1] + slopes[len(slopes) // 2]) // 2
    assert (row.samples, row.burn_bps_per_hour, row.confidence) == (kept, None if confidence == "insufficient" else middle, confidence)


def test_only_sound_windows_are_at_risk(spark):
    readings, window = _series(spark, [(0, 9000), (20, 9999), (40, 10000)])
    for stale, status, n in ((False, "healthy", 1), (True, "healthy", 0), (False, "error", 0)):
        assert quota.at_risk(quota.pace(readings, window.withColumns({"refresh_stale": F.lit(stale), "refresh_status": F.lit(status)}))).count() == n


def test_readings_are_cut_before_doubles_go(spark):
    points = [(i, 5 * i) for i in range(700)]
    readings, window = _series(spark, points)
    twice = readings.unionByName(readings.withColumns({"updated_at": F.expr("updated_at - INTERVAL '1' SECOND"), "utilization_bps": F.lit(1).cast("long")}))
    kept = quota.loaded(twice, window)
    assert kept.count() == quota.CAP // 2 and kept.agg(F.min("utilization_bps")).first()[0] == 5 * (700 - 256)


def test_responses_of_unlike_shape_are_two_snapshots(spark):
    at = lambda s: AT + timedelta(seconds=s)
    rows = [("p", w, "d", at(s), at(s), u, None, None) for s, w, u in ((0, "a", 1), (60, "a", 2), (60, "b", 3), (120, "a", 4), (120, "b", 5))]
    readings = spark.createDataFrame(rows, "provider string, window_key string, device_id string, observed_at timestamp_ntz, updated_at timestamp_ntz, utilization_bps long, period_starts_at timestamp_ntz, resets_at timestamp_ntz")
    found = quota.bucketed(readings).collect()
    assert len({r.snapshot_id for r in found}) == 2 and sorted((r.window_key, r.utilization_bps) for r in found) == [("a", 1), ("a", 4), ("b", 5)]
    newest = quota.latest(readings.unionByName(readings.where("window_key = 'a'").withColumn("observed_at", F.lit(at(300)).cast("timestamp_ntz"))))
    assert [(r.window_key, r.observed_at) for r in newest.collect() if r.updated_at == at(120)] == [("a", at(300))]


def test_hourly_merge_never_lowers(spark):
    schema = "device_id string, model_id string, hour long, prompt_tokens long, completion_tokens long, cached_tokens long, requests long"
    row = lambda p, r, c=5: spark.createDataFrame([("d", "m", 1, p, 20, c, r)], schema)
    table = row(100, 1)
    for p, r in ((160, 1), (10, 1), (167, 2), (167, 3)):
        table = merge.merge_hourly(table, row(p, r))
    assert [(x.prompt_tokens, x.requests) for x in table.collect()] == [(167, 3)]


def test_revisions_replace_only_if_greater(spark):
    stored = ledger(spark, event(1, total_tokens=10, model="m", native_cost_usd_ticks=3))
    same, more = event(1, total_tokens=10, model="m", output_tokens=0), event(1, total_tokens=11, model=None)
    assert merge.upsert_revisions(stored, ledger(spark, same)).first().sync_status == "synced"
    lesser = ledger(spark, event(1, total_tokens=9, model="z", project_name="q"), event(1, total_tokens=11, model=None))
    assert [(r.model, r.project_name) for r in merge.upsert_revisions(stored, lesser.where("total_tokens = 9")).collect()] == [("m", None)]
    assert [(r.model, r.project_name) for r in merge.upsert_revisions(stored, lesser).collect()] == [("m", None)]
    row = merge.upsert_revisions(stored, ledger(spark, more)).first()
    assert (row.total_tokens, row.model, row.native_cost_usd_ticks, row.sync_status, row.updated_at) == (11, "m", 3, "pending", AT + timedelta(microseconds=1))


def test_remote_rows_are_guarded(spark):
    stored = ledger(spark, event(1), event(2))
    remote = ledger(spark, event(1, total_tokens=5, updated_at=AT + timedelta(1), device_id="z"), event(2, total_tokens=5), event(3, project_name="a/b"), event(4) | {"id": "short"}, event(5))
    rows = {r.id[-1]: (r.total_tokens, r.device_id) for r in merge.apply_remote(stored, remote).collect()}
    assert rows == {"1": (5, "d"), "2": (0, "d"), "5": (0, "d")}


def test_quarantine_names_the_rules(spark):
    fine, odd = reconcile.quarantine(ledger(spark, event(1, reasoning_tokens=3)))
    assert fine.count() == 0 and set(odd.first().broken) == {"reasoning_over_output", "identity"}


def test_accounts_never_meet_in_merges(spark):
    ours, theirs = ledger(spark, event(1)), ledger(spark, event(1, account_id="b", total_tokens=9, updated_at=AT + timedelta(1)))
    for merged in (merge.insert_absent(ours, theirs), merge.upsert_revisions(ours, theirs), merge.apply_remote(ours, theirs)):
        assert sorted((r.account_id, r.total_tokens) for r in merged.collect()) == [("a", 0), ("b", 9)]


def test_legacy_rows_are_superseded_if_alone(spark):
    grok = {"provider": "grok", "source": "grok_build", "input_tokens": 9, "output_tokens": 4, "total_tokens": 13, "cache_write_tokens": 2}
    turn = [event(i, **grok | {"native_event_id": f"turn:t:model:{i}", "input_tokens": a, "output_tokens": 2, "total_tokens": a + 2, "cache_write_tokens": 0, "model": m}) for i, a, m in ((8, 4, "b"), (9, 5, "a"))]
    now = AT + timedelta(days=1)
    for stored, by in (([event(1, **grok)], event(8)["id"]), ([event(1, **grok), event(2, **grok)], None), ([event(1, **grok | {"total_tokens": 14})], None), ([event(1, **grok | {"native_event_id": "turn:x:model:y"})], None)):
        rows = ledger(spark, *stored)
        done = reconcile.superseded(rows, reconcile.by_shape(rows, ledger(spark, *turn)), now).where("id LIKE '%1'").first()
        assert (done.superseded_by_event_id, done.sync_status, done.updated_at) == (by, "pending" if by else "synced", now if by else AT)
    claude = {"provider": "claude", "source": "claude_code", "model": None, "cached_input_tokens": 3, "output_tokens": 4, "total_tokens": 20}
    request = ledger(spark, event(7, **claude | {"native_event_id": "request:r", "input_tokens": 5, "cache_write_tokens": 8}))
    for fields, hit in (({"input_tokens": 16}, True), ({"input_tokens": 5}, False), ({"input_tokens": 16, "model": "m"}, False), ({"input_tokens": 16, "native_event_id": "uuid:1"}, False), ({"input_tokens": 16, "reasoning_tokens": 1}, False)):
        assert (reconcile.by_recombined_input(ledger(spark, event(1, **claude | fields)), request).count() == 1) == hit


def test_runtime_says_nothing_of_a_model(spark):
    poll = lambda s, status, *models: ("d", "omlx", AT + timedelta(seconds=s), status, list(models))
    polls = spark.createDataFrame(
        [poll(0, "healthy", ("m", True), ("n", True)), poll(60, "healthy", ("m", None)), poll(120, "unavailable"), poll(180, "healthy", ("m", True)), poll(600, "unavailable"), poll(660, "healthy", ("m", False))],
        "device_id string, provider string, observed_at timestamp_ntz, status string, models array<struct<id:string,loaded:boolean>>",
    )
    found = sorted(((r.observed_at - AT).seconds, r.state, r.model or "") for r in runtime.transitions(polls).collect())
    assert found == [(0, "model_loaded", "m"), (0, "model_loaded", "n"), (0, "server_online", ""), (60, "model_unloaded", "n"), (120, "server_unavailable", ""), (180, "model_loaded", "m"), (180, "server_online", ""), (660, "server_online", "")]


def test_tenants_see_only_their_rows(spark):
    rows = ledger(spark, event(1, total_tokens=100), event(2, account_id="b", total_tokens=7))
    assert reconcile.of_account(rows, "a").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("t")).first() == (1, 100)


def test_outbound_columns_are_allow_listed(spark):
    out = merge.pending(ledger(spark, event(1, sync_status="pending", model="/etc/passwd")))
    assert "sync_status" not in out.columns and out.first().model is None


def test_scalar_rules(spark):
    df = spark.createDataFrame([(" C:\\a\\b<>x \\ ", "/rooted", "a%20b+c%zz", "2026-09-01T00:00:00.5+02:00", 2**63 - 1)], "p string, i string, u string, t string, n long")
    row = df.select(columns.project_name(F.col("p")).alias("p"), columns.safe_identifier(F.col("i")).alias("i"), columns.percent_decoded(F.col("u")).alias("u"), columns.rfc3339(F.col("t")).alias("t"), columns.saturating_add(F.col("n"), F.lit(9)).alias("n"), columns.basis_points(F.lit(3), F.lit(2)).alias("b")).first()
    assert row.p == "bx" and row.i is None and str(row.t) == "2026-08-31 22:00:00.500000" and row.n == 2**63 - 1 and row.b == 10000
    waits = spark.sql("SELECT explode(array(1, 2, 3, 9)) AS n").select(columns.backoff_seconds(F.col("n"), F.lit(None)).alias("w")).collect()
    assert [r.w for r in waits] == [300, 600, 1200, 3600]


def test_ranges_start_at_local_midnight():
    now = datetime(2026, 3, 30, 12)
    assert ranges.range_start("today", now, "Europe/Berlin") == datetime(2026, 3, 29, 22)
    assert ranges.range_start("7d", now) == datetime(2026, 3, 24) and ranges.range_start("all", now) is None
    assert ranges.range_start("month", now, "Europe/Berlin") == datetime(2026, 2, 28, 23)


def test_quota_buckets_without_period_or_reset(spark):
    at = lambda s: AT + timedelta(seconds=s)
    rows = [("claude", "w4", d, at(s), at(0), u, None, None) for d in ("d1", "d2") for s, u in ((0, 10), (290, 20), (290, 40), (290, 30), (301, 50))]
    readings = spark.createDataFrame(rows, "provider string, window_key string, device_id string, observed_at timestamp_ntz, updated_at timestamp_ntz, utilization_bps long, period_starts_at timestamp_ntz, resets_at timestamp_ntz")
    wanted = set()
    for device in ("d1", "d2"):
        for place, used in ((0, 40), (1, 50)):
            bucket = int((AT - datetime(1970, 1, 1)).total_seconds()) // 300 + place
            snapshot = sha256(f"claude|{device}|{bucket}|w4:0:0".encode()).hexdigest()
            wanted.add((snapshot, sha256(f"{snapshot}|w4".encode()).hexdigest(), device, bucket, used))
    assert {tuple(r) for r in quota.bucketed(readings).select("snapshot_id", "row_id", "device_id", "bucket", "utilization_bps").collect()} == wanted
