"""Dashboard reports over a priced ledger: each is one pass of conditional sums or one group-by."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import activity, canonical, layer
from ..functions.ranges import range_start


def defensible() -> Column:
    """Rows whose value counts in sums."""
    return F.col("pricing_status").isin("available", "partial") & F.col("estimated_api_value_usd_micros").isNotNull()


def since(start: datetime | None) -> Column:
    """Lower bound only: rows in the future count."""
    return F.lit(True) if start is None else F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz")


def _sum(column: str | Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(column) if isinstance(column, str) else column)), F.lit(0))


def headline(events: DataFrame, now: datetime, zone: str = "UTC", name: str = "month") -> DataFrame:
    """Counts, tokens of today, month and range, value and pricing coverage, in one scan."""
    counts, here = canonical(), canonical() & since(range_start(name, now, zone))
    valued = here & defensible()
    row = events.agg(
        _sum("total_tokens", counts & since(range_start("today", now, zone))).alias("tokens_today"),
        _sum("total_tokens", counts & since(range_start("month", now, zone))).alias("tokens_month"),
        F.count_if(here).alias("events"), _sum("total_tokens", here).alias("tokens"),
        F.sum(F.when(valued, F.col("estimated_api_value_usd_micros"))).alias("value_usd_micros"),
        F.count_if(here & (F.col("pricing_status") == "available")).alias("priced_events"),
        _sum("total_tokens", here & (F.col("pricing_status") == "available")).alias("priced_tokens"),
        F.count_if(activity() & since(range_start(name, now, zone))).alias("activity_minutes"),
    )
    complete = (F.col("events") > 0) & (F.col("priced_events") == F.col("events"))
    share = F.round(F.col("priced_tokens") * 100.0 / F.greatest("tokens", F.lit(1))).cast("long")
    return row.withColumns({"pricing_complete": complete, "pricing_coverage_percent": F.least(F.greatest(share, F.lit(0)), F.lit(100))})


def trend(events: DataFrame, start: datetime | None, only_runtime: bool = False) -> DataFrame:
    """Tokens of each UTC day that has any, with the share of the peak day."""
    rows = events.where(canonical() & since(start))
    if only_runtime:
        rows = rows.where(layer() == "runtime")
    days = rows.groupBy(F.col("occurred_at").cast("date").alias("day")).agg(F.sum("total_tokens").alias("tokens"))
    peak = days.agg(F.greatest(F.max("tokens"), F.lit(1)).alias("peak"))
    return days.join(F.broadcast(peak)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "MM/dd").alias("label"), "tokens", (F.col("tokens") * 100.0 / F.col("peak")).alias("percent_of_peak"))


def layers(events: DataFrame, start: datetime | None, observations: DataFrame | None = None) -> DataFrame:
    """Tokens counted by runtimes, by tools, and by unknown collectors; rows of runtimes, and their observations (observed_at)."""
    rows = events.where(canonical() & since(start)).withColumn("layer", layer())
    sums = rows.agg(*(_sum("total_tokens", F.col("layer") == x).alias(f"{x}_tokens") for x in ("runtime", "tool", "unknown")), F.count_if(F.col("layer") == "runtime").alias("runtime_events"))
    if observations is None:
        return sums
    seen = observations.where(F.lit(True) if start is None else F.col("observed_at") >= F.lit(start).cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("runtime_observations"))
    return sums.join(F.broadcast(seen), F.lit(True))  # a row each


#: Columns by which a ledger may be broken down, and the label of their nulls.
GROUPS = {"provider": "Unknown provider", "model": "Unknown model", "project_name": "Unknown project"}


def breakdown(events: DataFrame, by: str, start: datetime | None, top: int = 8) -> DataFrame:
    """Tokens, events and value of the top groups, and their percentage of all tokens in range."""
    if by not in GROUPS:
        raise ValueError(f"no breakdown by {by}")
    rows = events.where(canonical() & since(start))
    groups = rows.groupBy(F.coalesce(by, F.lit(GROUPS[by])).alias("name")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"), F.sum(F.when(defensible(), F.col("estimated_api_value_usd_micros"))).alias("value_usd_micros"))
    return _top(groups, rows, top)


def breakdown_devices(events: DataFrame, devices: DataFrame, start: datetime | None, top: int = 8) -> DataFrame:
    """The same by device; rows of unknown devices are left out."""
    rows = events.where(canonical() & since(start))
    groups = rows.join(devices, "device_id").groupBy("device_id", F.col("friendly_name").alias("name")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))
    return _top(groups, rows, top)


def _top(groups: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    total = rows.agg(F.greatest(F.sum("total_tokens"), F.lit(1)).alias("_all"))  # one row
    shares = groups.orderBy(F.desc("tokens"), "name").limit(top).join(F.broadcast(total))
    return shares.withColumn("percentage", F.col("tokens") * 100.0 / F.col("_all")).drop("_all")


def activity_page(events: DataFrame, devices: DataFrame, observations: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """Newest usage rows and runtime observations together, with their layer."""
    usage = events.where(F.col("superseded_by_event_id").isNull()).join(devices, "device_id").select("id", "occurred_at", "provider", "source", "model", "project_name", "total_tokens", "measurement_kind", "friendly_name", layer().alias("layer"))
    seen = observations.join(devices, "device_id").select(
        "id", F.col("observed_at").alias("occurred_at"), "provider", F.concat(F.lit("local_"), "state").alias("source"), "model", F.lit(None).cast("string").alias("project_name"),
        F.lit(0).cast("long").alias("total_tokens"), F.lit("runtime_status").alias("measurement_kind"), "friendly_name", F.lit("runtime").alias("layer"),
    )
    return usage.unionByName(seen).orderBy(F.desc("occurred_at"), F.desc("id")).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


#: What providers are called.
LABELS = {
    "codex": "Codex", "claude": "Claude Code CLI", "grok": "Grok Build", "gemini": "Gemini CLI", "omlx": "oMLX", "ollama": "Ollama", "lmstudio": "LM Studio",
    "openai": "ChatGPT Personal", "openai_business": "ChatGPT Business", "anthropic": "Claude", "xai": "Grok", "google": "Google AI / Gemini",
}


def provider_label() -> Column:
    """A provider's name; the key itself where it has none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("provider")], F.col("provider"))


def activity_filtered(page: DataFrame, search: str = "", **equal: str) -> DataFrame:
    """Rows of an activity page by layer, provider, friendly_name, project_name and model (those given), and by a text in project, model, device or provider."""
    for column in ("layer", "provider", "friendly_name", "project_name", "model"):
        if column in equal:
            page = page.where(F.col(column) == equal[column])
    text = F.lower(F.concat_ws(" ", F.coalesce("project_name", F.lit("")), F.coalesce("model", F.lit("")), "friendly_name", provider_label()))
    return page.where(text.contains(search.lower())) if search else page


def provider_options(rows: DataFrame, known: tuple[str, ...] = ("codex", "claude", "grok", "gemini")) -> DataFrame:
    """(provider, label): the providers that are always offered, and those of the rows, by label."""
    listed = rows.sparkSession.createDataFrame([(p,) for p in known], "provider string")
    return rows.select("provider").unionByName(listed).distinct().withColumn("label", provider_label()).orderBy("label", "provider")


def day_summary(page: DataFrame, zone: str = "UTC") -> DataFrame:
    """Of an activity list: measured tokens, minutes and observations of each local day."""
    measured, kind = F.col("measurement_kind") == "measured", F.col("measurement_kind")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), "occurred_at")
    return page.groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(_sum("total_tokens", measured).alias("tokens"), F.count_if(kind == "activity_only").alias("minutes"), F.count_if(kind == "runtime_status").alias("observations"))


def activity_options(page: DataFrame) -> DataFrame:
    """(list, value): the providers, devices, projects and models by which an activity list can be narrowed, those that occur in it."""
    lists = {"providers": "provider", "devices": "friendly_name", "projects": "project_name", "models": "model"}
    entries = F.array(*(F.struct(F.lit(n).alias("list"), F.col(c).alias("value")) for n, c in lists.items()))
    return page.select(F.explode(entries).alias("e")).select("e.list", "e.value").where("value <> ''").distinct().orderBy("list", "value")


def insights(events: DataFrame, now: datetime, start: datetime) -> DataFrame:
    """Largest provider, largest known project, and change against the period before: (id, subject, percent)."""
    rows = events.where(canonical() & since(start))
    by_provider = breakdown(events, "provider", start, 1).select(F.lit("top_provider").alias("id"), F.col("name").alias("subject"), F.col("percentage").alias("percent"))
    projects = breakdown(events, "project_name", start).where(F.col("name") != GROUPS["project_name"])
    by_project = projects.orderBy(F.desc("tokens"), "name").limit(1).select(F.lit("top_project").alias("id"), F.col("name").alias("subject"), F.col("percentage").alias("percent"))
    earlier = start - (now - start)
    window = events.where(canonical() & since(earlier)).agg(_sum("total_tokens", since(start)).alias("total"), _sum("total_tokens", ~since(start)).alias("before"))
    change = window.where((F.col("before") > 0) & F.lit(now - start <= timedelta(days=120))).select(
        F.lit("change").alias("id"), F.lit(None).cast("string").alias("subject"), ((F.col("total") - F.col("before")) * 100.0 / F.col("before")).alias("percent")
    )
    any_tokens = rows.where("total_tokens > 0").select(F.lit(1)).limit(1)
    return by_provider.unionByName(by_project).unionByName(change).join(F.broadcast(any_tokens), how="left_semi")


def ticker(events: DataFrame, now: datetime, zone: str = "UTC") -> DataFrame:
    """Tokens of each provider today and this month, and when it was last used."""
    today, month = since(range_start("today", now, zone)), since(range_start("month", now, zone))
    return events.where(canonical()).groupBy("provider").agg(_sum("total_tokens", today).alias("tokens_today"), _sum("total_tokens", month).alias("tokens_month"), F.max("occurred_at").alias("last_used"))


def scenarios(events: DataFrame, start: datetime | None) -> DataFrame:
    """Value of the range at price multipliers from 1 to 10 in steps of a half."""
    value = events.where(canonical() & since(start) & defensible()).agg(F.sum("estimated_api_value_usd_micros").alias("value"))
    steps = F.explode(F.sequence(F.lit(2), F.lit(20))).alias("halves")
    return value.select("value", steps).select((F.col("halves") / 2.0).alias("multiplier"), (F.col("value") * F.col("halves") / 2.0).alias("value_usd_micros"))


def subscriptions_total(subscriptions: DataFrame) -> DataFrame:
    """Monthly cents of active subscriptions; as reported (annual counts like monthly), and with a twelfth of annual prices."""
    active = F.col("active")
    monthly = F.when(F.col("cadence") == "annual", F.expr("price_cents div 12")).otherwise(F.col("price_cents"))
    return subscriptions.agg(_sum("price_cents", active).alias("monthly_cents"), _sum(monthly, active).alias("monthly_cents_spread"), F.count_if(active).alias("active"))


def tracking_status(events: DataFrame) -> DataFrame:
    """Minutes and last activity of each activity source; superseded rows are not left out."""
    return events.where(F.col("measurement_kind") == "activity_only").groupBy("source").agg(F.count(F.lit(1)).alias("minutes"), F.max("occurred_at").alias("last_activity"))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Additive measures by day and dimension, from which the other reports can be served."""
    keys = [F.col("occurred_at").cast("date").alias("day"), "provider", "source", "model", "project_name", "device_id"]
    return events.where(canonical()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("tokens"), F.sum(F.when(defensible(), F.col("estimated_api_value_usd_micros"))).alias("value_usd_micros"),
        F.count_if(F.col("pricing_status") == "available").alias("priced_events"),
    )
