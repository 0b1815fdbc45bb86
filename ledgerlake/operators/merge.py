"""Merging ledgers: replays, cumulative revisions, high-water buckets and other devices' rows.

No table format with MERGE is assumed: a merge returns the next version of the table. A
union and one window per key replace update statements, so each merge shuffles once.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hashed, safe_identifier


def keys_of(table: DataFrame) -> list[str]:
    """The key of a row: its id, within its account where the table has accounts."""
    return [c for c in ("account_id", "id") if c in table.columns]


#: What a row is: a revision that differs in any of these is another row with a stolen id.
IDENTITY = ["provider", "source", "source_type", "native_session_id", "native_event_id", "device_id", "measurement_kind"]


def _identity(columns: list[str]) -> Column:
    """Identity of a row as a struct of text; fields that the table lacks are left out."""
    same = [F.col(c).cast("string").alias(c) for c in IDENTITY if c in columns]
    by = F.col("superseded_by_event_id") if "superseded_by_event_id" in columns else F.lit(None).cast("string")
    return F.struct(by.alias("by"), *same)


def _revisable(have: Column, columns: list[str]) -> Column:
    """Whether a new row may revise the stored one of which have is the identity: the same row, and not superseded."""
    same = reduce(lambda a, b: a & b, [have[c].eqNullSafe(F.col(c).cast("string")) for c in IDENTITY if c in columns], F.lit(True))
    return have.isNull() | (have["by"].isNull() & same)


def insert_absent(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored and the incoming rows whose key it lacks; the first of repeated keys, so replays add nothing."""
    keys = keys_of(stored)
    fresh = incoming.join(stored.select(*keys), keys, "left_anti")  # the rest is usually small, and dealt by the same keys
    first = Window.partitionBy(*keys).orderBy("occurred_at", "native_event_id")
    return stored.unionByName(fresh.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))


def authority() -> Column:
    """What makes a revision of a request more complete; compared from left to right."""
    return F.struct(
        "total_tokens", (F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("split"), "output_tokens",
        F.col("model").isNotNull().alias("has_model"), F.col("project_name").isNotNull().alias("has_project"), "occurred_at",
    )


def upsert_revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The most authoritative revision of each key; equal or lesser ones than the stored row change nothing.

    A superseded row is never revised, nor one by a row of another identity (``guarded`` says which were refused).
    Model, project and native cost of a revision that wins fall back to those of the
    revisions it replaces; the row keeps its creation, is updated later than the stored one and queued again.
    """
    columns = stored.columns
    rows = stored.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True))).withColumn("_auth", authority())
    whole = Window.partitionBy(*keys_of(stored))
    of_stored = lambda c: F.max(F.when(~F.col("_new"), c)).over(whole)
    rows = rows.withColumns({"_have": of_stored(F.col("_auth")), "_who": of_stored(_identity(columns))})
    rows = rows.where(~F.col("_new") | (_revisable(F.col("_who"), columns) & (F.col("_have").isNull() | (F.col("_auth") > F.col("_have")))))
    order = whole.orderBy(F.desc("_auth"), "_new", F.desc("native_event_id"), F.desc("model"), F.desc("project_name"))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    keep = {c: F.first(c, ignorenulls=True).over(rest) for c in ("model", "project_name", "native_cost_usd_ticks")}
    if "created_at" in columns:
        keep["created_at"] = F.coalesce(of_stored(F.col("created_at")), "created_at")
    rows = rows.withColumns({**keep, "_old": of_stored(F.col("updated_at")), "_rank": F.row_number().over(order)}).where("_rank = 1")
    replaced = F.col("_new") & F.col("_old").isNotNull()
    return rows.withColumns({
        "updated_at": F.when(replaced, F.greatest(F.col("updated_at"), F.col("_old") + F.expr("INTERVAL '0.000001' SECOND"))).otherwise(F.col("updated_at")),
        "sync_status": F.when(F.col("_new"), "pending").otherwise(F.col("sync_status")),
    }).select(*columns)


def raise_cache_write(stored: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """stored with absent incoming rows added, and cache_write_tokens raised to incoming's where that is larger.

    Where it is raised, value and pricing status come from the incoming row, priced before, and the row is updated and queued again; nothing else
    changes. Superseded rows and rows of another identity are left alone.
    """
    keys, columns = keys_of(stored), stored.columns
    best = F.struct("cache_write_tokens", "estimated_api_value_usd_micros", "pricing_status")
    new = incoming.groupBy(*keys, _identity(columns).alias("_of")).agg(F.max(best).alias("_n"))
    joined = stored.join(new, keys)
    fits = _revisable(F.col("_of").withField("by", F.col("superseded_by_event_id")), columns)
    raised = fits & (F.col("_n.cache_write_tokens") > F.col("cache_write_tokens"))
    kept = joined.withColumn("_n", F.when(raised, F.col("_n"))).groupBy(*keys).agg(F.max("_n").alias("_n"))  # of several identities the one that fits
    rows = stored.join(kept, keys, "left").withColumn("_up", F.col("_n").isNotNull())
    at = F.greatest(F.lit(now).cast("timestamp_ntz"), F.col("updated_at") + F.expr("INTERVAL '0.000001' SECOND"))
    changed = {c: F.coalesce(f"_n.{c}", c) for c in ("cache_write_tokens", "pricing_status")} | {
        "estimated_api_value_usd_micros": F.when(F.col("_up"), F.col("_n.estimated_api_value_usd_micros")).otherwise(F.col("estimated_api_value_usd_micros")),
        "updated_at": F.when(F.col("_up"), at).otherwise(F.col("updated_at")), "sync_status": F.when(F.col("_up"), "pending").otherwise(F.col("sync_status")),
    }
    return insert_absent(rows.withColumns(changed).select(*columns), incoming)


def guarded(stored: DataFrame, incoming: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """incoming rows that may be merged into stored, and the others with ``refused``, the reasons: rules that they break (true where broken, as
    ``reconcile.rules``), other_identity or superseded. One join on the key; rows are told apart by it alone."""
    keys, columns = keys_of(stored), incoming.columns
    who = stored.groupBy(*keys).agg(F.max(_identity(stored.columns)).alias("_who"))
    rows = incoming.join(who, keys, "left")
    known = F.col("_who").isNotNull()
    same = _revisable(F.col("_who").withField("by", F.lit(None).cast("string")), stored.columns)
    reasons = [F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]
    reasons += [F.when(known & ~same, F.lit("other_identity")), F.when(known & F.col("_who.by").isNotNull(), F.lit("superseded"))]
    rows = rows.withColumn("refused", F.array_compact(F.array(*reasons)))
    return rows.where(F.size("refused") == 0).select(*columns), rows.where(F.size("refused") > 0).select(*columns, "refused")


def merge_hourly(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """High-water merge of hourly buckets (device_id, model_id, hour): counters that are all no less replace, requests only rise.

    Of several incoming rows of a bucket the greatest of those that may replace the stored one counts.
    """
    keys, counters = ["device_id", "model_id", "hour"], ["prompt_tokens", "completion_tokens", "cached_tokens"]
    old = stored.select(*keys, F.struct(*counters).alias("_old"))
    grown = reduce(lambda a, b: a & b, [F.col(c) >= F.col(f"_old.{c}") for c in counters])
    fits = F.when(F.col("_old").isNull() | grown, F.struct(*counters))
    new = incoming.join(old, keys, "left").groupBy(*keys).agg(F.max(fits).alias("n"), F.max("requests").alias("_requests"))
    rows = stored.join(new, keys, "full_outer")
    return rows.select(*keys, *(F.coalesce(f"n.{c}", c).alias(c) for c in counters), F.greatest("requests", "_requests").alias("requests"))


def hourly_events(buckets: DataFrame) -> DataFrame:
    """(id, provider, source, source_type, native_session_id, native_event_id, occurred_at, model, counters, device_id, requests): ledger rows of hourly buckets (device_id, model_id, hour, ...).

    A bucket is one event of a session made of its device and model; requests are kept beside the ledger.
    """
    second = (F.col("hour") * 3600).cast("string")
    session = hashed(F.lit("omlx-hour"), F.col("device_id"), F.col("model_id"))
    zero = F.lit(0).cast("long")
    return buckets.select(
        hashed(F.lit("omlx"), session, second).alias("id"), F.lit("omlx").alias("provider"), F.lit("omlx_usage_hourly").alias("source"), F.lit("api").alias("source_type"), session.alias("native_session_id"), second.alias("native_event_id"),
        F.expr("timestampadd(HOUR, hour, TIMESTAMP_NTZ '1970-01-01')").alias("occurred_at"), F.col("model_id").alias("model"), F.col("prompt_tokens").alias("input_tokens"), F.col("cached_tokens").alias("cached_input_tokens"),
        zero.alias("cache_write_tokens"), F.col("completion_tokens").alias("output_tokens"), zero.alias("reasoning_tokens"), F.try_add("prompt_tokens", "completion_tokens").alias("total_tokens"), F.lit("measured").alias("measurement_kind"), "device_id", "requests",
    )


#: Rows of a source of hourly history that are read at most, and the version of its schema.
MOST_HOURLY, HOURLY_VERSION = 250_000, 1


def accepted_history(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hourly rows of the sources (source_id, version) whose schema is known and that are not too long, and the others with the reason; rows have source_id."""
    sizes = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    judged = sources.join(sizes, "source_id", "left").withColumn("reason", F.when(F.col("version") != HOURLY_VERSION, "unsupported_version").when(F.col("_n") > MOST_HOURLY, "too_long"))
    return rows.join(judged.where("reason IS NULL").select("source_id"), "source_id", "left_semi"), judged.where("reason IS NOT NULL").select("source_id", "reason")


def valid_hourly(rows: DataFrame, now_hour: int) -> DataFrame:
    """Buckets with a possible hour, non-negative counters that add up, and a plain model id."""
    fine = F.col("hour").between(0, now_hour) & (F.least("requests", "prompt_tokens", "completion_tokens", "cached_tokens") >= 0) & (F.col("cached_tokens") <= F.col("prompt_tokens"))
    return rows.where(fine & F.try_add("prompt_tokens", "completion_tokens").isNotNull() & safe_identifier(F.col("model_id")).isNotNull())


def apply_remote(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows are added, or replace a stored row that is older; device and creation stay.

    Of events, odd ids and path-like projects are refused; subscriptions have neither.
    """
    if "native_event_id" in stored.columns:
        remote = remote.where((F.length("id") == 64) & ~F.coalesce(F.col("project_name").rlike(r"[/\\]"), F.lit(False)))
    rows = stored.withColumn("_local", F.lit(1)).unionByName(remote.where("id IS NOT NULL").withColumn("_local", F.lit(0)))
    local = Window.partitionBy(*keys_of(stored))
    order = local.orderBy(F.desc("updated_at"), F.desc("_local"))
    stay = {c: F.coalesce(F.max(F.when(F.col("_local") == 1, F.col(c))).over(local), F.col(c)) for c in ("device_id", "created_at") if c in stored.columns}
    return rows.withColumns({**stay, "_r": F.row_number().over(order)}).where("_r = 1").select(*stored.columns)


def apply_remote_devices(stored: DataFrame, remote: DataFrame, own: str) -> DataFrame:
    """Last writer wins; this device's own row is never taken from elsewhere, missing labels get a default."""
    named = remote.where(F.col("device_id") != own).withColumn("friendly_name", F.coalesce("friendly_name", F.lit("Unnamed device")))
    rows = stored.withColumn("_local", F.lit(1)).unionByName(named.withColumn("_local", F.lit(0)))
    order = Window.partitionBy("device_id").orderBy(F.desc("updated_at"), F.desc("_local"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*stored.columns)


#: The only columns that may leave a device.
OUTBOUND = [
    "id", "provider", "source", "source_type", "native_session_id", "native_event_id", "occurred_at", "model", "project_name", "input_tokens", "cached_input_tokens", "cache_write_tokens",
    "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "estimated_api_value_usd_micros", "native_cost_usd_ticks", "pricing_status",
    "measurement_kind", "device_id", "created_at", "updated_at", "superseded_by_event_id",
]


def pending(events: DataFrame, batch: int = 250) -> DataFrame:
    """Rows to deliver, oldest first within an account, in numbered batches; unsafe models become null."""
    rows = events.where(F.col("sync_status").isin("pending", "error")).withColumn("batch", F.expr(f"(row_number() OVER (PARTITION BY account_id ORDER BY created_at, id) - 1) div {batch}"))
    return rows.withColumn("model", safe_identifier(F.col("model"))).select("account_id", "batch", *OUTBOUND)


def acknowledged(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """events with delivered rows marked synced, each account's by itself; a row that was updated since it was sent stays in the queue."""
    keys = [k for k in keys_of(events) if k in delivered.columns]
    if "updated_at" in delivered.columns:
        sent = delivered.groupBy(*keys).agg(F.max("updated_at").alias("_sent"))
        rows = events.join(sent, keys, "left").withColumn("_done", F.col("updated_at") <= F.col("_sent"))
    else:
        rows = events.join(delivered.select(*keys, F.lit(True).alias("_done")).distinct(), keys, "left")
    return rows.withColumn("sync_status", F.when(F.col("_done"), "synced").otherwise(F.col("sync_status"))).select(*events.columns)


def pulled(remote: DataFrame, cursor: Column, high_water: Column) -> DataFrame:
    """Rows after the cursor up to the high water taken before the read."""
    return remote.where((F.col("updated_at") > cursor) & (F.col("updated_at") <= high_water))
