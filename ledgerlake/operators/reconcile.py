"""Reconciliation of legacy rows with their replacements, health of collectors, and validity of rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hashed, saturating_add
from . import merge

SHAPE = ["native_session_id", "occurred_at", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
# How native event ids of today's collectors begin; others are of former ones.
CLAUDE_IDS = ["request:", "message:", "uuid:", "request_fingerprint:"]


def legacy(provider: str) -> Column:
    """Rows that a former collector of the provider wrote, and nothing supersedes."""
    source, native = {"claude": "claude_code", "grok": "grok_build"}[provider], F.col("native_event_id")
    todays = native.rlike(f"^({'|'.join(CLAUDE_IDS)})") if provider == "claude" else native.like("turn:%:model:%")
    return (F.col("provider") == provider) & (F.col("source") == source) & F.col("superseded_by_event_id").isNull() & ~todays


def _account(*tables: DataFrame) -> list[str]:
    """The account as part of a key, where all tables have it."""
    return ["account_id"] if all("account_id" in t.columns for t in tables) else []


def superseded(events: DataFrame, pairs: DataFrame, now: datetime) -> DataFrame:
    """events with the legacy rows of pairs (account_id, legacy_event_id, replacement_event_id) superseded, updated and queued again; without accounts in pairs, ids are one account's."""
    account = _account(events, pairs)
    one = pairs.groupBy(*account, F.col("legacy_event_id").alias("id")).agg(F.min("replacement_event_id").alias("_by"))
    rows = events.join(one, [*account, "id"], "left")
    new = F.col("_by").isNotNull() & F.col("superseded_by_event_id").isNull()
    return rows.withColumns({
        "updated_at": F.when(new, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")), "sync_status": F.when(new, "pending").otherwise(F.col("sync_status")),
        "superseded_by_event_id": F.coalesce("superseded_by_event_id", "_by"),
    }).select(*events.columns)


def by_hints(events: DataFrame, hints: DataFrame, now: datetime) -> DataFrame:
    """events with the Claude rows superseded that a hint proves to be replaced by a Claude row of the ledger; hints of an account (account_id) are about its rows."""
    account = _account(events, hints)
    new = events.where("provider = 'claude'").select(*account, F.col("id").alias("replacement_event_id"))
    proven = hints.where("legacy_event_id <> replacement_event_id").join(new, [*account, "replacement_event_id"], "left_semi")
    old = events.where("provider = 'claude' AND source = 'claude_code'").select(*account, F.col("id").alias("legacy_event_id"))
    return superseded(events, proven.join(old, [*account, "legacy_event_id"], "left_semi"), now)


def by_shape(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(account_id, legacy_event_id, replacement_event_id): legacy Grok rows whose counters, alone in the ledger, are those of a completed turn over all its models.

    The replacement is the turn's last row by model; of several turns with the same counters the first counts.
    """
    account = _account(stored, events)
    unique = stored.where(legacy("grok")).groupBy(*account, *SHAPE).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("legacy_event_id")).where("n = 1")
    rows = events.where((F.col("provider") == "grok") & F.col("native_event_id").contains(":model:")).withColumn("turn_id", F.substring_index("native_event_id", ":model:", 1))
    last = F.max_by("id", F.struct(F.coalesce("model", F.lit("")), "native_event_id")).alias("last_id")
    turns = rows.groupBy(*account, "native_session_id", "turn_id").agg(F.max("occurred_at").alias("occurred_at"), *(F.sum(c).alias(c) for c in SHAPE[2:]), last)
    first = turns.groupBy(*account, *SHAPE).agg(F.min_by("last_id", "turn_id").alias("replacement_event_id"))
    return unique.join(first, [*account, *SHAPE]).select(*account, "legacy_event_id", "replacement_event_id")


def by_recombined_input(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(account_id, legacy_event_id, replacement_event_id): legacy Claude rows that counted all input as one, alone in the ledger, and the first request with such counters.

    A legacy row has no cache writes and no reasoning; a model is the same also where both are unknown.
    """
    account = _account(stored, events)
    shape = [*account, "native_session_id", "occurred_at", "_model", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens"]
    known = F.struct(F.col("model").isNull(), F.coalesce("model", F.lit(""))).alias("_model")
    plain = (F.col("cache_write_tokens") == 0) & (F.col("cache_write_5m_tokens") == 0) & (F.col("cache_write_1h_tokens") == 0) & (F.col("reasoning_tokens") == 0)
    old = stored.where(legacy("claude") & plain).withColumn("_model", known)
    unique = old.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("legacy_event_id")).where("n = 1")
    whole = saturating_add(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("cache_write_tokens"))
    new = events.where("provider = 'claude'").withColumns({"_model": known, "input_tokens": whole}).groupBy(*shape).agg(F.min("id").alias("replacement_event_id"))
    return unique.join(new, shape).where("legacy_event_id <> replacement_event_id").select(*account, "legacy_event_id", "replacement_event_id")


def unreconciled(events: DataFrame) -> DataFrame:
    """Legacy rows that nothing supersedes, by provider."""
    return events.where(legacy("claude") | legacy("grok")).groupBy("provider").agg(F.count(F.lit(1)).alias("unreconciled"))


def provider_summary(events: DataFrame) -> DataFrame:
    """Rows, sessions, turns, tokens, cache use and native cost of each provider's active measured rows, and how many of them a former collector wrote."""
    turn = F.concat("native_session_id", F.lit(":"), F.substring_index("native_event_id", ":model:", 1))
    rows = events.where((F.col("measurement_kind") == "measured") & F.col("superseded_by_event_id").isNull())
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("native_session_id").alias("sessions"), F.countDistinct(turn).alias("turns"), F.sum("total_tokens").alias("tokens"),
        F.sum("cached_input_tokens").alias("cache_read"), F.sum("cache_write_tokens").alias("cache_write"), F.sum("native_cost_usd_ticks").alias("native_cost_usd_ticks"), F.max("occurred_at").alias("last_usage"),
        F.count_if(legacy("claude") | legacy("grok")).alias("unreconciled"),
    )


def with_all_providers(summary: DataFrame, providers: list[str]) -> DataFrame:
    """summary with zero rows for the providers it lacks."""
    spark = summary.sparkSession
    listed = spark.createDataFrame([(p,) for p in providers], "provider string")
    rows = listed.join(summary.withColumn("_there", F.lit(True)), "provider", "left")
    filled = {c: F.when(F.col("_there").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long") for c, t in summary.dtypes if t == "bigint"}
    return rows.withColumns(filled).select(*summary.columns)


def health(diagnostics: DataFrame) -> DataFrame:
    """error before warning before healthy, for each provider, with the first 20 diagnostics counted."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    rows = diagnostics.groupBy("provider").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n"))
    return rows.select("provider", F.element_at(F.array(*map(F.lit, ("healthy", "warning", "error"))), F.col("r") + 1).alias("health"), F.least("n", F.lit(20)).alias("shown"))


def first_diagnostics(diagnostics: DataFrame, top: int = 20) -> DataFrame:
    order = Window.partitionBy("provider").orderBy("path", "line", "code")
    return diagnostics.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def rules() -> dict[str, Column]:
    """Domain checks of a ledger row; true where the row breaks one."""
    counters = [c for c in ("input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "total_tokens")]
    return {
        "negative_counter": F.least(*counters) < 0,
        "unknown_source_type": ~F.col("source_type").isin("local_cli", "browser", "api", "manual"),
        "unknown_pricing_status": ~F.col("pricing_status").isin("available", "unavailable", "partial"),
        "unknown_kind": ~F.col("measurement_kind").isin("measured", "estimated", "activity_only"),
        "odd_id": F.length("id") != 64,
        "write_under_split": F.col("cache_write_tokens") < F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens"),
        "reasoning_over_output": F.col("reasoning_tokens") > F.col("output_tokens"),
        "identity": F.col("id") != hashed(F.col("provider"), F.col("native_session_id"), F.col("native_event_id")),
    }


def validity(events: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, rows): how many rows break each rule, in one pass; by default the rules of ledger rows."""
    checks = rules() if checks is None else checks
    counts = events.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()))
    return counts.unpivot([], list(checks), "rule", "rows")


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the rules they break."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules().items())), lambda x: x.isNotNull())
    rows = events.withColumn("broken", broken)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)


def identity_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming revisions that disagree with the stored row of their account and id about who they are, or whose row is superseded."""
    return merge.guarded(stored, incoming, {})[1].drop("refused")


#: Domain checks of other tables; true where a row breaks one.
def subscription_rules() -> dict[str, Column]:
    return {"negative_price": F.col("price_cents") < 0, "unknown_cadence": ~F.col("cadence").isin("monthly", "annual")}


def window_rules() -> dict[str, Column]:
    """Of quota windows: utilisation within 0..10000, labels of 1 to 80 characters."""
    return {"odd_utilization": ~F.col("utilization_bps").between(0, 10_000), "odd_label": ~F.length("label").between(1, 80)}


def of_account(events: DataFrame, account: str) -> DataFrame:
    """One tenant's rows; every multi-tenant read goes through this filter."""
    return events.where(F.col("account_id") == account)
