"""A rollup of the ledger kept up to date by signed deltas, and the dashboard's reports from it.

The rollup has a row for each quarter of an hour and group, with measures that add up. Local days of all zones
begin at quarters, so reports by local time come from it too. A merge changes it by what the rows it
touched were and what they are: both are rolled up, the former negative, in one grouping, where unchanged rows
cancel. Reports read the rollup alone, whatever the ledger's size.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import activity, canonical, layer
from ..functions.ranges import range_start
from .dashboard import GROUPS, defensible

SLOT_MINUTES = 15
KEYS = ["slot", "provider", "source", "model", "project_name", "device_id"]
MEASURES = ["events", "tokens", "valued_events", "value_usd_micros", "priced_events", "priced_tokens", "activity_minutes"]


def _slot(column: str) -> Column:
    return F.timestamp_add("MINUTE", F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01', {column}) div {SLOT_MINUTES} * {SLOT_MINUTES}"), F.expr("TIMESTAMP_NTZ '1970-01-01'"))


def _measures() -> dict[str, Column]:
    counts, valued, priced = canonical(), canonical() & defensible(), canonical() & (F.col("pricing_status") == "available")
    one = lambda where: F.when(where, 1).otherwise(0)
    return {
        "events": one(counts), "tokens": F.when(counts, F.col("total_tokens")).otherwise(0), "valued_events": one(valued), "value_usd_micros": F.when(valued, F.col("estimated_api_value_usd_micros")).otherwise(0),
        "priced_events": one(priced), "priced_tokens": F.when(priced, F.col("total_tokens")).otherwise(0), "activity_minutes": one(activity()),
    }


def _summed(rows: DataFrame) -> DataFrame:
    """Rows (KEYS, MEASURES) added up by group; groups in which nothing is left are gone."""
    sums = rows.groupBy(*KEYS).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))
    return sums.where(" OR ".join(f"{m} <> 0" for m in MEASURES))


def _signed(events: DataFrame, sign: int) -> DataFrame:
    rows = events.where(canonical() | activity()).withColumn("slot", _slot("occurred_at"))
    return rows.select(*KEYS, *((c * sign).cast("long").alias(m) for m, c in _measures().items()))


def rolled(events: DataFrame) -> DataFrame:
    """The rollup of priced ledger rows."""
    return _summed(_signed(events, 1))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes in the rollup when rows before become rows after: those that a merge touched, or any rows among which they are."""
    return _summed(_signed(before, -1).unionByName(_signed(after, 1)))


def added(rollup: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The rollup after deltas, in any order."""
    for d in deltas:
        rollup = rollup.unionByName(d)
    return _summed(rollup)


def _since(start: datetime | None) -> Column:
    return F.lit(True) if start is None else F.col("slot") >= F.lit(start).cast("timestamp_ntz")


def _in(measure: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(measure))), F.lit(0)).cast("long")


def headline(rollup: DataFrame, now: datetime, zone: str = "UTC", name: str = "month") -> DataFrame:
    """``dashboard.headline`` from the rollup, and how many events have a value."""
    here = _since(range_start(name, now, zone))
    row = rollup.agg(
        _in("tokens", _since(range_start("today", now, zone))).alias("tokens_today"), _in("tokens", _since(range_start("month", now, zone))).alias("tokens_month"),
        *(_in(m, here).alias(m) for m in ("events", "tokens", "valued_events", "priced_events", "priced_tokens", "activity_minutes")), _in("value_usd_micros", here).alias("_value"),
    )
    share = F.round(F.col("priced_tokens") * 100.0 / F.greatest("tokens", F.lit(1))).cast("long")
    return row.withColumns({
        "value_usd_micros": F.when(F.col("valued_events") > 0, F.col("_value")), "pricing_complete": (F.col("events") > 0) & (F.col("priced_events") == F.col("events")),
        "pricing_coverage_percent": F.least(F.greatest(share, F.lit(0)), F.lit(100)),
    }).drop("_value")


def trend(rollup: DataFrame, start: datetime | None) -> DataFrame:
    """Tokens of each UTC day that has events."""
    days = rollup.where(_since(start)).groupBy(F.date_format("slot", "yyyy-MM-dd").alias("day")).agg(F.sum("tokens").alias("tokens"), F.sum("events").alias("_n"))
    return days.where("_n > 0").drop("_n")


def breakdown(rollup: DataFrame, by: str, start: datetime | None, top: int = 8) -> DataFrame:
    """Tokens, events and value of the top groups."""
    groups = rollup.where(_since(start)).groupBy(F.coalesce(by, F.lit(GROUPS[by])).alias("name")).agg(*(F.sum(m).alias(m) for m in ("tokens", "events", "valued_events", "value_usd_micros")))
    valued = F.when(F.col("valued_events") > 0, F.col("value_usd_micros")).alias("value_usd_micros")
    return groups.where("events > 0").orderBy(F.desc("tokens"), "name").limit(top).select("name", "tokens", "events", valued)


def layers(rollup: DataFrame, start: datetime | None) -> DataFrame:
    """Tokens counted by runtimes, by tools, and by unknown collectors."""
    rows = rollup.where(_since(start)).withColumn("layer", layer())
    return rows.agg(*(_in("tokens", F.col("layer") == x).alias(f"{x}_tokens") for x in ("runtime", "tool", "unknown")), _in("events", F.col("layer") == "runtime").alias("runtime_events"))


def snapshot(rollup: DataFrame, now: datetime, start: datetime | None, name: str = "month") -> DataFrame:
    """The dashboard in one row: the headline, and as arrays the trend, the breakdowns and the layers. All of it is small: days, and the top groups."""
    listed = lambda rows, order, label: rows.agg(F.array_sort(F.collect_list(F.struct(*order))).alias(label))
    parts = [headline(rollup, now, name=name), layers(rollup, start), listed(trend(rollup, start), ("day", "tokens"), "trend")]
    for by in GROUPS:
        ranked = breakdown(rollup, by, start).withColumn("less", -F.col("tokens"))
        parts.append(listed(ranked, ("less", "name", "tokens", "events", "value_usd_micros"), f"by_{by}"))
    rows = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(row, "_one")  # rows of one each
    return out.drop("_one")
