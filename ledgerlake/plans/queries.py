"""Registered queries: each applies an operator to a ledger over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical, hashed
from ..functions.ranges import range_start
from ..operators import cache, dashboard, keyset, merge, pricing, quota, reconcile, rollup, runtime, sessions
from ..sources import catalogue, derived, logs, responses
from ..sources.ledger import NOW, devices, ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MONTH, WEEK, LAST_30 = (range_start(x, NOW) for x in ("month", "7d", "30d"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, priced."""
    return pricing.priced(ledger(spark, sf_dir), catalogue.validated(catalogue.rules(spark)))


@query
def ledger_rows(spark, sf_dir):
    return ledger(spark, sf_dir)


@query
def dashboard_headline(spark, sf_dir):
    return dashboard.headline(valued(spark, sf_dir), NOW, name="30d")


@query
def dashboard_trend(spark, sf_dir):
    return dashboard.trend(ledger(spark, sf_dir), LAST_30)


@query
def dashboard_runtime_trend(spark, sf_dir):
    return dashboard.trend(ledger(spark, sf_dir), LAST_30, only_runtime=True)


@query
def dashboard_layers(spark, sf_dir):
    return dashboard.layers(ledger(spark, sf_dir), LAST_30, runtime.transitions(derived.polls(spark, sf_dir)))


@query
def breakdown_by_provider(spark, sf_dir):
    return dashboard.breakdown(valued(spark, sf_dir), "provider", LAST_30)


@query
def breakdown_by_model(spark, sf_dir):
    return dashboard.breakdown(valued(spark, sf_dir), "model", LAST_30)


@query
def breakdown_by_project(spark, sf_dir):
    return dashboard.breakdown(valued(spark, sf_dir), "project_name", LAST_30)


@query
def breakdown_by_device(spark, sf_dir):
    return dashboard.breakdown_devices(ledger(spark, sf_dir), devices(spark, sf_dir), LAST_30)


@query
def dashboard_insights(spark, sf_dir):
    return dashboard.insights(ledger(spark, sf_dir), NOW, WEEK)


@query
def provider_ticker(spark, sf_dir):
    return dashboard.ticker(ledger(spark, sf_dir), NOW)


@query
def price_scenarios(spark, sf_dir):
    return dashboard.scenarios(valued(spark, sf_dir), LAST_30)


@query
def tracking_status(spark, sf_dir):
    return dashboard.tracking_status(ledger(spark, sf_dir))


@query
def daily_rollup(spark, sf_dir):
    return dashboard.daily_rollup(valued(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _kept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup of part of the ledger, brought up to date by the deltas of two merges: absent rows, then revisions of which some are refused."""
    events = valued(spark, sf_dir)
    first = events.where("sync_status <> 'pending'")
    second = merge.insert_absent(first, events)
    third = merge.upsert_revisions(second, _revised(events))
    return rollup.added(rollup.rolled(first), rollup.delta(first, second), rollup.delta(second, third))


def _revised(events: DataFrame) -> DataFrame:
    more = {"total_tokens": F.col("total_tokens") + 100, "occurred_at": F.expr("occurred_at + INTERVAL '20' MINUTE"), "project_name": F.lit("Revised")}
    return events.where("total_tokens % 4 = 1").withColumns(more)


@query
def rollup_after_merges(spark, sf_dir):
    return _kept_rollup(spark, sf_dir)


@query
def rollup_headline(spark, sf_dir):
    return rollup.headline(_kept_rollup(spark, sf_dir), NOW, name="30d")


@query
def rollup_breakdowns(spark, sf_dir):
    rows = _kept_rollup(spark, sf_dir)
    found = [rollup.breakdown(rows, by, LAST_30).withColumn("by", F.lit(by)) for by in dashboard.GROUPS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def rollup_snapshot(spark, sf_dir):
    """The dashboard's one row from the rollup, its arrays as text."""
    row = rollup.snapshot(rollup.rolled(valued(spark, sf_dir)), NOW, LAST_30, name="30d")
    listed = {f"by_{by}": F.array_join(F.transform(f"by_{by}", lambda x: F.concat_ws("=", x["name"], x["tokens"].cast("string"))), ";") for by in dashboard.GROUPS}
    return row.withColumns(listed | {"trend": F.array_join(F.transform("trend", lambda x: F.concat_ws("=", x["day"], x["tokens"].cast("string"))), ";")})


@query
def priced_events(spark, sf_dir):
    return valued(spark, sf_dir).select("id", "model", "estimated_api_value_usd_micros", "pricing_status")


@query
def repriced_events(spark, sf_dir):
    return pricing.repriced(ledger(spark, sf_dir), catalogue.rules(spark)).select("id", "estimated_api_value_usd_micros", "pricing_status", "sync_status")


@query
def price_rules(spark, sf_dir):
    """Rules that price at least one event, and how many."""
    ruled = pricing.with_rule(ledger(spark, sf_dir), catalogue.rules(spark)).where("rule IS NOT NULL")
    return ruled.groupBy("provider", F.when(F.col("rule.exact"), F.col("model")).otherwise(F.lit("*")).alias("exact_model"), F.col("rule.effective_from").alias("effective_from"), F.col("rule.min_input").alias("min_input")).agg(F.count(F.lit(1)).alias("events"))


@query
def session_list(spark, sf_dir):
    return sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), LAST_30)


@query
def session_search(spark, sf_dir):
    return sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), WEEK, search="Sonnet")


@query
def session_provider(spark, sf_dir):
    """The sessions of one provider."""
    found = sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), LAST_30, provider="claude")
    return found.select("session_key", "events", "total_tokens", "models", "project")


@query
def session_page(spark, sf_dir):
    found = sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), LAST_30)
    return sessions.page(found, "value").select("place", "session_key", "total_tokens", "value_usd_micros", "has_more", "relative_tokens", sessions.age_group(NOW).alias("age_group"))


@query
def session_stats(spark, sf_dir):
    return sessions.stats(sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), WEEK))


@query
def cache_report(spark, sf_dir):
    return cache.report(ledger(spark, sf_dir), catalogue.rules(spark), LAST_30)


@query
def cache_by_session(spark, sf_dir):
    return cache.by_session(ledger(spark, sf_dir), catalogue.rules(spark))


@query
def cache_providers(spark, sf_dir):
    return cache.providers(ledger(spark, sf_dir), WEEK)


def _looked() -> Column:
    """When a window is looked at: 0, 400, 800 or 1200 seconds after it was observed, by day."""
    return F.expr("observed_at + make_dt_interval(0, 0, 0, dayofmonth(observed_at) % 4 * 400)")


@query
def quota_pace(spark, sf_dir):
    readings = derived.quota_readings(spark, sf_dir)
    return quota.pace(readings, derived.quota_windows(readings), _looked())


@query
def quota_at_risk(spark, sf_dir):
    readings = derived.quota_readings(spark, sf_dir)
    return quota.at_risk(quota.pace(readings, derived.quota_windows(readings), _looked())).select("window_key", "device_id", "status", "projected_full_at")


def monthly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings, those of each month as of another provider."""
    return derived.quota_readings(spark, sf_dir).withColumn("provider", F.concat(F.lit("claude-"), F.date_format("observed_at", "yyyyMM")))


@query
def quota_latest(spark, sf_dir):
    return quota.latest(monthly_readings(spark, sf_dir)).select("provider", "window_key", "device_id", "observed_at", "utilization_bps")


def responses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as responses: those of a device and minute came at once, and the last of a window counts."""
    minute = F.date_trunc("minute", F.col("observed_at").cast("timestamp")).cast("timestamp_ntz")
    rows = derived.quota_readings(spark, sf_dir).withColumn("minute", minute)
    last = rows.groupBy("provider", "window_key", "device_id", "minute", "period_starts_at", "resets_at").agg(F.max(F.struct("observed_at", "utilization_bps")).alias("l"))
    return last.select("provider", "window_key", "device_id", F.col("minute").alias("observed_at"), F.col("minute").alias("updated_at"), "period_starts_at", "resets_at", F.col("l.utilization_bps").alias("utilization_bps"))


@query
def provider_quota_state(spark, sf_dir):
    readings = monthly_readings(spark, sf_dir)
    day = F.substring("device_id", 5, 8)
    devices_ = readings.select("device_id").distinct().where(day.cast("int") % 2 == 0).withColumn("friendly_name", F.concat(F.lit("Day "), day))
    refreshes = readings.select("provider").distinct().withColumn("m", F.substring("provider", -1, 1).cast("int")).where("m % 3 <> 0").select("provider", F.when(F.col("m") % 2 == 0, "healthy").otherwise("error").alias("status"))
    found = quota.state(readings, devices_, refreshes)
    return found.withColumn("windows", F.array_join(F.transform("windows", lambda w: F.concat(w["window_key"], F.lit("="), w["utilization_bps"])), ","))


@query
def quota_buckets(spark, sf_dir):
    return quota.bucketed(responses_of(spark, sf_dir)).select("snapshot_id", "row_id", "window_key", "device_id", "bucket", "utilization_bps")


@query
def merge_replay(spark, sf_dir):
    """Replaying the whole ledger over two thirds of it gives it once."""
    events = ledger(spark, sf_dir)
    stored = events.where("sync_status <> 'pending'")
    return merge.insert_absent(stored, events.unionByName(events.where("sync_status = 'error'"))).select("id", "provider", "total_tokens", "sync_status")


@query
def merge_revisions(spark, sf_dir):
    rows = derived.revisions(spark, sf_dir)
    stored, incoming = (rows.where(F.col("half") == h).drop("half") for h in (0, 1))
    once = merge.upsert_revisions(stored.limit(0), stored).withColumn("sync_status", F.lit("synced"))
    return merge.upsert_revisions(once, incoming).select("id", "model", "project_name", "total_tokens", "output_tokens", "occurred_at", "updated_at", "sync_status")


@query
def merge_tenants(spark, sf_dir):
    """Rows of two accounts with the same ids, merged three ways: neither account's rows change the other's."""
    stored = ledger(spark, sf_dir).where("account_id = 'account-0'").withColumn("sync_status", F.lit("synced"))
    other = stored.withColumns({"account_id": F.lit("account-b"), "total_tokens": F.col("total_tokens") + 1, "updated_at": F.expr("updated_at + INTERVAL '1' DAY")})
    merged = [merge.insert_absent(stored, other), merge.upsert_revisions(stored, other), merge.apply_remote(stored, other)]
    counted = [m.groupBy("account_id").agg(F.lit(i).alias("merge"), F.count(F.lit(1)).alias("rows"), F.sum("total_tokens").alias("tokens")) for i, m in enumerate(merged)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def merge_subscriptions(spark, sf_dir):
    stored = derived.subscriptions(spark, sf_dir).withColumn("updated_at", F.lit(WEEK).cast("timestamp_ntz"))
    remote = stored.withColumns({"price_cents": F.col("price_cents") + 100, "updated_at": F.expr("updated_at + make_dt_interval(id % 3 - 1)")})
    remote = remote.withColumn("id", F.expr("if(id % 10 = 0, -1 - id, id)"))
    return merge.apply_remote(stored, remote).select("id", "price_cents", "updated_at")


@query
def merge_cache_write(spark, sf_dir):
    """Codex rows come again, some with a larger cache write, some as of another device, and some under a new id; superseded ones stay."""
    events = ledger(spark, sf_dir)
    again = events.where("provider = 'codex'").withColumns({
        "cache_write_tokens": F.col("cache_write_tokens") + F.expr("total_tokens % 3 - 1"), "device_id": F.expr("if(total_tokens % 11 = 1, 'device-x', device_id)"),
        "estimated_api_value_usd_micros": F.col("total_tokens") * 2, "pricing_status": F.lit("available"), "id": F.expr("if(total_tokens % 13 = 1, sha2(id, 256), id)"),
    })
    return merge.raise_cache_write(events, again, NOW).select("id", "cache_write_tokens", "estimated_api_value_usd_micros", "pricing_status", "device_id", "updated_at", "sync_status")


@query
def merge_guarded(spark, sf_dir):
    """All rows come again with more tokens: some of another device, some under an id that is not theirs, some of superseded rows; what may be merged is."""
    stored = ledger(spark, sf_dir)
    again = stored.withColumns({
        "total_tokens": F.col("total_tokens") + 10, "device_id": F.expr("if(total_tokens % 11 = 1, 'device-x', device_id)"), "id": F.expr("if(total_tokens % 13 = 1, sha2(id, 256), id)"), "created_at": F.lit(NOW).cast("timestamp_ntz"),
    })
    fine, _ = merge.guarded(stored, again, reconcile.rules())
    return merge.upsert_revisions(stored, fine).select("id", "device_id", "total_tokens", "created_at", "updated_at", "superseded_by_event_id", "sync_status")


@query
def merge_refused(spark, sf_dir):
    """The rows of ``merge_guarded`` that are not merged, by reason; the other account's rows of the same ids are fine."""
    stored = ledger(spark, sf_dir)
    again = stored.withColumns({"device_id": F.expr("if(total_tokens % 11 = 1, 'device-x', device_id)"), "id": F.expr("if(total_tokens % 13 = 1, sha2(id, 256), id)")})
    other = stored.withColumns({"account_id": F.lit("account-b"), "device_id": F.lit("device-b")})
    _, refused = merge.guarded(stored, again.unionByName(other), reconcile.rules())
    return refused.groupBy("account_id", F.array_join("refused", ",").alias("refused")).agg(F.count(F.lit(1)).alias("rows"))


@query
def acknowledged_tenants(spark, sf_dir):
    """Rows of two accounts with the same ids; those of one are delivered, and some of them were updated since."""
    events = ledger(spark, sf_dir).withColumn("sync_status", F.lit("pending"))
    both = events.unionByName(events.withColumn("account_id", F.lit("account-b")))
    sent = events.withColumn("updated_at", F.expr("updated_at + make_dt_interval(0, 0, 0, total_tokens % 3 - 1)"))
    done = merge.acknowledged(both, sent)
    return done.groupBy((F.col("account_id") == "account-b").alias("other"), "sync_status").agg(F.count(F.lit(1)).alias("rows"))


@query
def row_rules(spark, sf_dir):
    """How many subscriptions and quota windows break each of their rules."""
    prices = derived.subscriptions(spark, sf_dir).withColumns({"price_cents": F.expr("if(id % 10 = 3, -1, price_cents)"), "cadence": F.expr("if(id % 7 = 2, 'weekly', cadence)")})
    windows = responses.flat_and_dynamic_windows(derived.quota_responses(spark, sf_dir)).withColumns({"utilization_bps": F.expr("if(response_id % 9 = 4, utilization_bps + 9000, utilization_bps)"), "label": F.expr("if(response_id % 8 = 5, repeat(label, 20), label)")})
    return reconcile.validity(prices, reconcile.subscription_rules()).unionByName(reconcile.validity(windows, reconcile.window_rules()))


@query
def merge_hourly(spark, sf_dir):
    events = ledger(spark, sf_dir).where("provider = 'omlx' AND model IS NOT NULL")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01', occurred_at)")
    buckets = lambda rows: rows.groupBy("device_id", F.col("model").alias("model_id"), hour.alias("hour")).agg(
        F.sum("input_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("completion_tokens"), F.sum("cached_input_tokens").alias("cached_tokens"), F.count(F.lit(1)).alias("requests")
    )
    return merge.merge_hourly(merge.valid_hourly(buckets(events.where("measurement_kind <> 'estimated'")), 600_000), merge.valid_hourly(buckets(events.where("sync_status = 'synced'")), 600_000))


@query
def merge_remote(spark, sf_dir):
    events = ledger(spark, sf_dir)
    remote = events.where("total_tokens % 5 < 3").withColumns({
        "updated_at": F.expr("updated_at + make_dt_interval(0, 0, 0, total_tokens % 5 - 1)"), "total_tokens": F.col("total_tokens") + 1, "device_id": F.lit("elsewhere"),
        "project_name": F.when(F.col("project_name") == "Project-3", "/home/x").otherwise(F.col("project_name")),
    })
    return merge.apply_remote(events, remote).select("id", "total_tokens", "device_id", "project_name")


@query
def pending_batches(spark, sf_dir):
    return merge.pending(ledger(spark, sf_dir)).groupBy("account_id", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("oldest"), F.sum("total_tokens").alias("tokens"))


@query
def acknowledged_rows(spark, sf_dir):
    events = ledger(spark, sf_dir)
    done = merge.acknowledged(events, events.where("sync_status = 'error' AND provider <> 'grok'"))
    return done.groupBy("provider", "sync_status").agg(F.count(F.lit(1)).alias("rows"))


@query
def pulled_rows(spark, sf_dir):
    from_, to = (F.lit(t).cast("timestamp_ntz") for t in (WEEK, NOW))
    return merge.pulled(ledger(spark, sf_dir), from_, to).groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"), F.max("updated_at").alias("cursor"))


def _number_of(column: str = "native_event_id"):
    return F.substring_index(column, ":", -1).cast("long")


@query
def reconcile_shapes(spark, sf_dir):
    """Legacy Grok rows, superseded by turns of two models with the same counters; every third turn counts one token more."""
    stored = ledger(spark, sf_dir).where("provider = 'grok'")
    halves = stored.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    share = lambda c: F.expr(f"if(part = 0, {c} div 3, {c} - {c} div 3)")
    counters = {c: share(c) for c in reconcile.SHAPE[2:]}
    turns = halves.withColumns(counters).withColumns({
        "total_tokens": F.col("total_tokens") + F.when((_number_of() % 3 == 0) & (F.col("part") == 0), 1).otherwise(0), "model": F.when(F.col("part") == 0, F.lit("a")).otherwise(F.lit("b")),
        "native_event_id": F.concat(F.lit("turn:"), _number_of(), F.lit(":model:"), "part"),
    })
    turns = turns.withColumn("id", hashed(F.col("provider"), F.col("native_session_id"), F.col("native_event_id")))
    done = reconcile.superseded(stored, reconcile.by_shape(stored, turns), NOW)
    return done.select("id", "superseded_by_event_id", "updated_at", "sync_status")


@query
def reconcile_recombined(spark, sf_dir):
    """Legacy Claude rows that counted all input as one, superseded by requests; every fifth has a double."""
    rows = ledger(spark, sf_dir).where("provider = 'claude' AND measurement_kind = 'measured'")
    requests = rows.withColumns({"native_event_id": F.concat(F.lit("request:"), _number_of()), "id": F.concat(F.lit("new-"), "id")})
    zero = {c: F.lit(0).cast("long") for c in ("cache_write_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "reasoning_tokens")}
    old = rows.withColumns({"input_tokens": F.col("input_tokens") + F.col("cached_input_tokens") + F.col("cache_write_tokens"), **zero})
    stored = old.unionByName(old.where(_number_of() % 5 == 0).withColumn("id", F.concat(F.lit("double-"), "id")))
    done = reconcile.superseded(stored, reconcile.by_recombined_input(stored, requests), NOW)
    return done.select("id", "superseded_by_event_id", "sync_status")


@query
def reconcile_hints(spark, sf_dir):
    events = ledger(spark, sf_dir)
    following = events.select(F.col("native_event_id").alias("n"), F.col("id").alias("replacement_event_id"))
    hints = events.select(F.col("id").alias("legacy_event_id"), F.concat(F.lit("event:"), _number_of() + 6).alias("n")).join(following, "n")
    done = reconcile.by_hints(events, hints.select("legacy_event_id", "replacement_event_id"), NOW)
    return done.where("provider IN ('claude', 'grok')").select("id", "superseded_by_event_id", "updated_at", "sync_status")


@query
def provider_summary(spark, sf_dir):
    """Rows of Gemini count as of Codex, so one provider has none; three of four Claude and Grok rows have ids of today's collectors."""
    n = _number_of()
    native = F.when(n % 4 == 0, F.col("native_event_id")).when(F.col("provider") == "claude", F.concat(F.lit("request:"), n)).otherwise(F.concat(F.lit("turn:"), F.floor(n / 12), F.lit(":model:"), n))
    rows = ledger(spark, sf_dir).withColumns({"provider": F.expr("if(provider = 'gemini', 'codex', provider)"), "native_event_id": native})
    found = reconcile.provider_summary(rows)
    return reconcile.with_all_providers(found, ["codex", "claude", "grok", "gemini"])


@query
def ledger_validity(spark, sf_dir):
    return reconcile.validity(ledger(spark, sf_dir).withColumns({"reasoning_tokens": F.expr("if(total_tokens % 97 = 1, output_tokens + 1, reasoning_tokens)"), "provider": F.expr("if(total_tokens % 89 = 1, 'other', provider)")}))


@query
def account_totals(spark, sf_dir):
    return reconcile.of_account(ledger(spark, sf_dir), "account-1").groupBy("account_id", "provider").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_tokens").alias("tokens"))


@query
def runtime_transitions(spark, sf_dir):
    return runtime.transitions(derived.polls(spark, sf_dir))


@query
def runtime_first_seen(spark, sf_dir):
    return runtime.first_seen(derived.polls(spark, sf_dir))


@query
def runtime_counts(spark, sf_dir):
    """0 to 150 seconds after each device's last poll; the runtimes of every seventh device are disabled."""
    number = F.substring_index("device_id", "-", -1).cast("int")
    settings = derived.polls(spark, sf_dir).select("device_id", "provider").distinct().withColumn("enabled", number % 7 != 5)
    return runtime.counts(derived.polls(spark, sf_dir), F.expr("observed_at + make_dt_interval(0, 0, 0, cast(substring_index(device_id, '-', -1) as int) % 4 * 50)"), settings)


@query
def local_snapshot(spark, sf_dir):
    """Of the device with the last nation's number, over the last week."""
    events = ledger(spark, sf_dir)
    details = events.select(F.col("id").alias("event_id"), (F.col("total_tokens") % 5).alias("requests"))
    return runtime.local_snapshot(events, details, runtime.transitions(derived.polls(spark, sf_dir)), WEEK, "device-23")


@query
def enriched_models(spark, sf_dir):
    """Revisions without a model take that of the stored row, unless another device wrote it or it is superseded; then they are priced."""
    stored = ledger(spark, sf_dir)
    revisions = stored.withColumns({"model": F.expr("if(total_tokens % 2 = 0, model, NULL)"), "device_id": F.expr("if(total_tokens % 7 = 1, 'device-x', device_id)")})
    priced = pricing.priced(pricing.with_stored_model(revisions, stored), catalogue.rules(spark))
    return priced.groupBy("provider", "pricing_status").agg(F.count(F.lit(1)).alias("rows"), F.count("model").alias("with_model"), F.sum("estimated_api_value_usd_micros").alias("value"))


@query
def provider_options(spark, sf_dir):
    """Codex rows count as of Ollama, so one of the providers that are always offered has no row."""
    return dashboard.provider_options(ledger(spark, sf_dir).withColumn("provider", F.expr("if(provider = 'codex', 'ollama', provider)")))


def _activity(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    seen = runtime.transitions(derived.polls(spark, sf_dir)).withColumn("id", F.sha2(F.concat_ws("|", "device_id", F.col("observed_at").cast("string"), "state", F.coalesce("model", F.lit(""))), 256))
    return dashboard.activity_page(ledger(spark, sf_dir), devices(spark, sf_dir), seen, limit)


@query
def activity_search(spark, sf_dir):
    """Of the newest 500 rows, those of one layer and provider whose project, model, device or provider has a text."""
    found = dashboard.activity_filtered(_activity(spark, sf_dir, 500), "PROJECT-3", layer="tool")
    return found.select("id", "provider", "project_name", "layer")


@query
def activity_options(spark, sf_dir):
    """What the newest 500 rows can be narrowed by."""
    return dashboard.activity_options(_activity(spark, sf_dir, 500))


@query
def activity_keyset(spark, sf_dir):
    """The second and third page of 200 usage rows, each behind the last row of the one before."""
    rows = ledger(spark, sf_dir).select("id", "occurred_at", "provider", "total_tokens")
    first = keyset.end_of(keyset.page(rows, keyset.ACTIVITY, 200), keyset.ACTIVITY)
    second = keyset.page(rows, keyset.ACTIVITY, 200, first)
    third = keyset.page(rows, keyset.ACTIVITY, 200, keyset.end_of(second, keyset.ACTIVITY))
    return second.unionByName(third)


@query
def session_keyset(spark, sf_dir):
    """The second page of 50 sessions by value, those without one last."""
    rows, order = sessions.sessions(valued(spark, sf_dir), devices(spark, sf_dir), LAST_30), keyset.SESSIONS["value"]
    return keyset.page(rows, order, 50, keyset.end_of(keyset.page(rows, order, 50), order)).select("session_key", "total_tokens", "value_usd_micros")


@query
def activity_page(spark, sf_dir):
    seen = runtime.transitions(derived.polls(spark, sf_dir)).withColumn("id", F.sha2(F.concat_ws("|", "device_id", F.col("observed_at").cast("string"), "state", F.coalesce("model", F.lit(""))), 256))
    return dashboard.activity_page(ledger(spark, sf_dir), devices(spark, sf_dir), seen, 500).select("id", "provider", "source", "measurement_kind", "total_tokens", "friendly_name", "layer")


@query
def scan_codex(spark, sf_dir):
    """Logs in splits of three lines, so most lines get their session, model and project from earlier splits."""
    return logs.codex(logs.split(derived.codex_logs(spark, sf_dir), 3))[0].drop("path", "line", "native_cost_usd_ticks")


@query
def scan_codex_diagnostics(spark, sf_dir):
    found = logs.codex(derived.codex_logs(spark, sf_dir))[1]
    return reconcile.health(found)


@query
def scan_claude(spark, sf_dir):
    events, _ = logs.claude(derived.claude_logs(spark, sf_dir))
    return events.select("native_session_id", "native_event_id", "occurred_at", "model", "input_tokens", "output_tokens", "total_tokens")


@query
def scan_claude_hints(spark, sf_dir):
    """Of all records, the ids that a former collector gave beside those of requests; records come as splits of two lines."""
    return logs.claude_hints(logs.split(derived.claude_logs(spark, sf_dir), 2))


@query
def scan_report(spark, sf_dir):
    """What a scan of three providers' logs saw; Gemini has none."""
    files = {"codex": derived.codex_logs, "claude": derived.claude_logs, "grok": derived.grok_logs}
    tallies, found = zip(*(logs.scanned(logs.split(read(spark, sf_dir)), name) for name, read in files.items()))
    report = logs.scan_report(reduce(DataFrame.unionByName, tallies), reduce(DataFrame.unionByName, found), [*files, "gemini"])
    return report.withColumn("diagnostics", F.array_join("diagnostics", ","))


@query
def scan_grok(spark, sf_dir):
    events, _ = logs.grok(derived.grok_logs(spark, sf_dir))
    return events.select("native_session_id", "occurred_at", "model", "project_name", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "native_cost_usd_ticks")


@query
def scan_grok_diagnostics(spark, sf_dir):
    return logs.grok(derived.grok_logs(spark, sf_dir))[1].groupBy("code").agg(F.count(F.lit(1)).alias("rows"))


@query
def scan_gemini(spark, sf_dir):
    events, _ = logs.gemini(derived.gemini_logs(spark, sf_dir))
    return events.select("native_session_id", "native_event_id", "occurred_at", "model", "project_name", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


@query
def scan_manifest(spark, sf_dir):
    """Entries of the Codex logs after a scan; entries of every third log were there, with another parser."""
    files = derived.codex_logs(spark, sf_dir).withColumns({"size": F.length("content"), "modified": F.lit(WEEK).cast("timestamp_ntz")})
    events, found = logs.codex(files)
    none = logs.manifest_after(spark.createDataFrame([], MANIFEST), files.limit(0), events.limit(0), found.limit(0), "codex", 1, WEEK)
    before = logs.manifest_after(none, files.where("size % 3 = 0"), events, found, "codex", 1, WEEK)
    after = logs.manifest_after(before, logs.changed(files, before, 2), events, found, "codex", 2, NOW)
    return after.select("source_key", "parser_version", "last_scan_at", "last_usage_at", "status", "diagnostic")


MANIFEST = "source_key string, provider string, fingerprint string, file_size long, parser_version int, last_scan_at timestamp_ntz, last_usage_at timestamp_ntz, status string, diagnostic string"


@query
def runtime_inventory(spark, sf_dir):
    return responses.models(derived.inventories(spark, sf_dir)).select("response_id", "model", "loaded", "context_length", "size_bytes", "parameters")


@query
def quota_windows(spark, sf_dir):
    return responses.flat_and_dynamic_windows(derived.quota_responses(spark, sf_dir))


@query
def billing_windows(spark, sf_dir):
    return responses.billing_windows(derived.billing_responses(spark, sf_dir)).select("response_id", "key", "kind", "utilization_bps", "period_starts_at")


@query
def extra_usage(spark, sf_dir):
    return responses.extra_usage(derived.billing_responses(spark, sf_dir))


@query
def claude_extra_usage(spark, sf_dir):
    return responses.claude_extra_usage(derived.quota_responses(spark, sf_dir))


@query
def hourly_events(spark, sf_dir):
    """Ledger rows of the hourly buckets of a source of a known version; a source of another version is refused."""
    events = ledger(spark, sf_dir).where("provider = 'omlx' AND model IS NOT NULL AND cached_input_tokens <= input_tokens").withColumn("source_id", F.col("device_id"))
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01', occurred_at)").alias("hour")
    rows = events.groupBy("source_id", "device_id", F.col("model").alias("model_id"), hour).agg(
        F.sum("input_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("completion_tokens"), F.sum("cached_input_tokens").alias("cached_tokens"), F.count(F.lit(1)).alias("requests")
    )
    sources = rows.select("source_id").distinct().withColumn("version", F.when(F.col("source_id").endswith("3"), 2).otherwise(1))
    fine, _ = merge.accepted_history(rows, sources)
    return merge.hourly_events(merge.valid_hourly(fine, 600_000)).select("id", "native_session_id", "native_event_id", "occurred_at", "model", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "device_id", "requests")


@query
def subscription_total(spark, sf_dir):
    return dashboard.subscriptions_total(derived.subscriptions(spark, sf_dir))


@query
def refresh_state(spark, sf_dir):
    return quota.refresh_state(derived.refresh_attempts(spark, sf_dir)).select("provider", "status", "attempted_at", "failures", "wait_seconds", "retry_at")


@query
def session_details(spark, sf_dir):
    """Details of every session: what the list shows, with device names; hourly rows count."""
    rows = ledger(spark, sf_dir).where(canonical()).join(devices(spark, sf_dir), "device_id")
    return sessions.detail(rows).select(*sessions.KEYS, "started_at", "last_activity_at", "events", "total_tokens", "models", "device_names", "relevant")


def _detailed(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.where(canonical()).join(names, "device_id")


@query
def session_models(spark, sf_dir):
    return sessions.detail_models(_detailed(ledger(spark, sf_dir), devices(spark, sf_dir)))


@query
def session_devices(spark, sf_dir):
    return sessions.detail_devices(_detailed(ledger(spark, sf_dir), devices(spark, sf_dir)))


@query
def session_timeline(spark, sf_dir):
    """The first two rows of every session."""
    return sessions.timeline(_detailed(valued(spark, sf_dir), devices(spark, sf_dir)), limit=2)


@query
def cache_shown(spark, sf_dir):
    return cache.shown(cache.report(ledger(spark, sf_dir), catalogue.rules(spark), LAST_30), "model").select("label", "cache_read_tokens", "cache_write_tokens", "reuse_bps")


@query
def unreconciled_legacy(spark, sf_dir):
    """Four of five rows got ids of today's collectors."""
    n = _number_of()
    todays = F.when(F.col("provider") == "claude", F.concat(F.element_at(F.array(*map(F.lit, reconcile.CLAUDE_IDS)), (n % 4 + 1).cast("int")), n)).otherwise(F.concat(F.lit("turn:"), n, F.lit(":model:x")))
    return reconcile.unreconciled(ledger(spark, sf_dir).withColumn("native_event_id", F.when(n % 5 == 0, F.col("native_event_id")).otherwise(todays)))


@query
def quarantined(spark, sf_dir):
    odd = ledger(spark, sf_dir).withColumn("reasoning_tokens", F.expr("if(total_tokens % 97 = 1, output_tokens + 1, reasoning_tokens)"))
    return reconcile.quarantine(odd)[1].select("id", F.array_join("broken", ",").alias("broken"))


@query
def identity_conflicts(spark, sf_dir):
    events = ledger(spark, sf_dir)
    changed = events.withColumn("device_id", F.expr("if(total_tokens % 13 = 1, 'device-x', device_id)"))
    return reconcile.identity_conflicts(events, changed).select("id", "device_id")


@query
def day_summary(spark, sf_dir):
    seen = runtime.transitions(derived.polls(spark, sf_dir)).withColumn("id", F.lit("x"))
    usage = ledger(spark, sf_dir).select("occurred_at", "total_tokens", "measurement_kind")
    both = usage.unionByName(seen.select(F.col("observed_at").alias("occurred_at"), F.lit(0).cast("long").alias("total_tokens"), F.lit("runtime_status").alias("measurement_kind")))
    return dashboard.day_summary(both, "Europe/Berlin")


@query
def retained_observations(spark, sf_dir):
    return runtime.retained(runtime.transitions(derived.polls(spark, sf_dir)), NOW).groupBy("device_id", "state").agg(F.count(F.lit(1)).alias("rows"), F.min("observed_at").alias("first"))
