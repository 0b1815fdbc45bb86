"""Sessions, derived at read time: (provider, source, native session).

Range and search qualify a session; its totals then count all its eligible rows. Sessions
that are active in the range bound the rows first, by a semi join. Rows are then summed by
session, project, model and device, before the shuffle; all that a session shows follows
from those groups, which are few, so nothing is counted distinct and nothing ranked by a
window over rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical, coverage, hashed
from ..sources.ledger import COUNTERS
from .dashboard import since

KEYS = ["provider", "source", "native_session_id"]
HOURLY = "omlx_usage_hourly"


def eligible(events: DataFrame, devices: DataFrame) -> DataFrame:
    return events.where(canonical() & (F.col("source") != HOURLY)).join(devices, "device_id")


def matches(search: str) -> Column:
    """Whether a row has the text; % and _ in it are wildcards."""
    words = [F.coalesce("project_name", F.lit("")), "provider", "source", F.coalesce("model", F.lit("")), "friendly_name"]
    return F.lower(F.concat_ws(" ", *words)).like(f"%{search.strip().lower()}%")


def _totals() -> list[Column]:
    relevant = F.col("total_tokens") > 0
    defensible = relevant & F.col("pricing_status").isin("available", "partial") & F.col("estimated_api_value_usd_micros").isNotNull()
    return [
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_activity_at"), F.count(F.lit(1)).alias("events"),
        *(F.sum(c).alias(c) for c in COUNTERS),
        F.sum(F.when(defensible, F.col("estimated_api_value_usd_micros"))).alias("value_usd_micros"), F.sum("native_cost_usd_ticks").alias("native_cost_usd_ticks"),
        F.count_if(relevant).alias("relevant"), F.count_if(defensible & (F.col("pricing_status") == "available")).alias("full"), F.count_if(defensible).alias("defensible"),
        F.countDistinct("device_id").alias("devices"), F.min("friendly_name").alias("first_device"), F.countDistinct("model").alias("models"),
    ]


#: Names of the totals, in order.
TOTALS = ["started_at", "last_activity_at", "events", *COUNTERS, "value_usd_micros", "native_cost_usd_ticks", "relevant", "full", "defensible", "devices", "first_device", "models"]


def sessions(events: DataFrame, devices: DataFrame, start: datetime | None, provider: str = "", search: str = "") -> DataFrame:
    """A row for each session that qualifies."""
    rows = eligible(events, devices)
    if provider:
        rows = rows.where(F.col("provider") == provider)
    if start is not None:
        active = events.where(canonical() & (F.col("source") != HOURLY) & since(start)).select(*KEYS).distinct()
        rows = rows.join(active, KEYS, "left_semi")
    totals = _grouped(rows, search)
    if start is not None:  # the active row may be that of an unknown device
        totals = totals.where(F.col("last_activity_at") >= F.lit(start).cast("timestamp_ntz"))
    return totals.select(
        hashed(*map(F.col, KEYS)).alias("session_key"), *KEYS, "started_at", "last_activity_at", F.greatest(F.expr("timestampdiff(SECOND, started_at, last_activity_at)"), F.lit(0)).alias("duration_seconds"),
        "events", *COUNTERS, "value_usd_micros", "native_cost_usd_ticks", coverage(F.col("full"), F.col("defensible"), F.col("relevant")).alias("coverage"), "devices", "first_device", "models",
        F.coalesce("top_project", F.lit("Unassigned")).alias("project"), F.coalesce("top_model", F.lit("Unknown model")).alias("model"),
    )


def _grouped(rows: DataFrame, search: str) -> DataFrame:
    """Totals of the sessions of which a row has the text, with top project (rows, latest, name) and model (tokens, rows, name)."""
    dimensions = ["project_name", "model", "device_id", "friendly_name"]
    sums = [*COUNTERS, "value_usd_micros", "native_cost_usd_ticks", "relevant", "full", "defensible", "events"]
    distinct = ("devices", "models")
    groups = rows.groupBy(*KEYS, *dimensions).agg(*(t for t, name in zip(_totals(), TOTALS) if name not in (*distinct, "first_device")))
    found = F.max(matches(search)) if search.strip() else F.lit(True)
    late = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', last_activity_at)").alias("late")
    totals = groups.groupBy(*KEYS).agg(
        F.min("started_at").alias("started_at"), F.max("last_activity_at").alias("last_activity_at"), *(F.sum(c).alias(c) for c in sums), F.size(F.collect_set("device_id")).cast("long").alias("devices"),
        F.min("friendly_name").alias("first_device"), F.size(F.collect_set("model")).cast("long").alias("models"), found.alias("_found"),
        F.collect_list(F.struct("project_name", "model", F.col("events").alias("n"), F.col("total_tokens").alias("tokens"), late)).alias("g"),
    ).where("_found")

    def top(field: str, *worth: str) -> Column:
        """The name whose groups are worth most; of equal ones the first by name."""
        names = f"array_distinct(filter(transform(g, x -> x.{field}), x -> x IS NOT NULL))"
        of = f"filter(g, x -> x.{field} = name)"
        amount = {c: f"-aggregate({of}, 0L, (s, x) -> s + x.{c})" for c in ("n", "tokens")} | {"late": f"-array_max(transform({of}, x -> x.late))"}
        ranks = ", ".join(f"{amount[w]} AS {w}" for w in worth)
        return F.expr(f"array_min(transform({names}, name -> struct({ranks}, name AS name))).name")

    return totals.withColumns({"top_project": top("project_name", "n", "late"), "top_model": top("model", "tokens", "n")}).drop("g", "_found")


# Sort modes of a session page.
ORDERS = {
    "recent": ["last_activity_at"], "tokens": ["total_tokens", "last_activity_at"],
    "value": ["value_usd_micros", "last_activity_at"], "duration": ["duration_seconds", "last_activity_at"],
}


def page(found: DataFrame, sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions with has_more and the tokens relative to the largest session on it."""
    limit = min(max(limit, 1), 50)
    order = [F.desc_nulls_last(c) for c in ORDERS.get(sort, ORDERS["recent"])] + [F.asc(k) for k in reversed(KEYS)]
    rows = found.orderBy(*order).offset(max(offset, 0)).limit(limit + 1)  # one more than shown
    whole = Window.partitionBy()
    place = F.row_number().over(whole.orderBy(*order))
    shown = rows.withColumns({"place": place, "_n": F.count(F.lit(1)).over(whole)}).where(F.col("place") <= limit)
    largest = F.greatest(F.max("total_tokens").over(whole), F.lit(1))
    return shown.withColumns({"has_more": F.col("_n") > limit, "relative_tokens": F.col("total_tokens") * 1.0 / largest}).drop("_n")


def stats(found: DataFrame) -> DataFrame:
    """Of all qualifying sessions, not of a page."""
    return found.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.sum("value_usd_micros").alias("value_usd_micros"))


def one(events: DataFrame, devices: DataFrame, key: tuple[str, str, str]) -> DataFrame:
    """Eligible rows of one session; here hourly rows count."""
    at = F.lit(True)
    for name, value in zip(KEYS, key):
        at &= F.col(name) == value
    return events.where(canonical() & at).join(devices, "device_id")


def detail(rows: DataFrame) -> DataFrame:
    """Totals of a session; no row if it has none."""
    return rows.groupBy(*KEYS).agg(*_totals(), F.countDistinct("friendly_name").alias("device_names"))


def detail_models(rows: DataFrame) -> DataFrame:
    """The models of each session of rows, most tokens first."""
    groups = rows.groupBy(*KEYS, F.coalesce("model", F.lit("Unknown model")).alias("model")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))
    return groups.orderBy(*KEYS, F.desc("tokens"), F.desc("events"), "model")


def detail_devices(rows: DataFrame) -> DataFrame:
    """The names of the devices of each session of rows."""
    return rows.select(*KEYS, "friendly_name").distinct().orderBy(*KEYS, "friendly_name")


def timeline(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the rows of each session, oldest first, and whether the session has more; the page is its bound."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    session = Window.partitionBy(*KEYS)
    placed = rows.withColumns({"place": F.row_number().over(session.orderBy("occurred_at", "id")), "has_more": F.count(F.lit(1)).over(session) > offset + limit})
    shown = placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return shown.select(*KEYS, "place", "id", "occurred_at", "model", "total_tokens", "estimated_api_value_usd_micros", "pricing_status", "has_more")


def age_group(now: datetime) -> Column:
    """Today, Yesterday, Earlier this week, Older."""
    days = F.datediff(F.lit(now).cast("date"), F.col("last_activity_at").cast("date"))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Earlier this week").otherwise("Older")

