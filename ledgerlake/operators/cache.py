"""Cache efficiency: every row is priced once, then one aggregate over grouping sets makes all breakdowns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basis_points, canonical, coverage, fresh_input, semantics
from .dashboard import since
from .pricing import with_cache_impact


def measured(events: DataFrame, rules: DataFrame, start: datetime | None, provider: str = "") -> DataFrame:
    """Canonical rows with the measures of one row."""
    rows = events.where(canonical() & since(start))
    if provider:
        rows = rows.where(F.col("provider") == provider)
    rows = with_cache_impact(rows, rules).withColumn("kind", semantics())
    rows = rows.withColumns({"fresh": fresh_input(F.col("kind")), "known": F.col("kind").isNotNull()})
    return rows.withColumn("context", F.col("fresh") + F.col("cached_input_tokens") + F.col("cache_write_tokens"))


def _sums() -> list[Column]:
    known, relevant = F.col("known"), F.col("cache_pricing").isNotNull()
    return [
        F.count(F.lit(1)).alias("events"), F.count_if(known).alias("known_events"), F.sum(F.when(known, F.col("fresh"))).alias("fresh"),
        F.sum(F.when(known, F.col("cached_input_tokens"))).alias("known_cached"), F.sum(F.when(known, F.col("context"))).alias("context"),
        F.sum("cached_input_tokens").alias("cached"), F.sum("cache_write_tokens").alias("write"), F.sum("cache_write_5m_tokens").alias("w5"), F.sum("cache_write_1h_tokens").alias("w1"),
        F.count_if(relevant).alias("relevant"), F.count_if(F.col("cache_impact_usd_micros").isNotNull()).alias("valued"),
        F.count_if(F.col("cache_pricing") == "complete").alias("complete"), F.sum("cache_impact_usd_micros").alias("impact"),
    ]


def _finished(groups: DataFrame, *keys: str) -> DataFrame:
    w5 = F.least("w5", "write")
    w1 = F.greatest(F.least(F.col("w1"), F.col("write") - w5), F.lit(0))
    reuse = F.when((F.col("known_events") > 0) & (F.col("context") > 0), basis_points(F.col("known_cached"), F.col("context")))
    pricing = F.when(F.col("valued") == 0, "unavailable").when(F.col("complete") == F.col("relevant"), "complete").otherwise("partial")
    return groups.select(
        *keys, "events", coverage(F.col("known_events"), F.col("known_events"), F.col("events")).alias("semantic_coverage"), F.col("fresh").alias("fresh_input_tokens"),
        F.col("context").alias("input_context_tokens"), F.col("cached").alias("cache_read_tokens"), F.col("write").alias("cache_write_tokens"), w5.alias("cache_write_5m_tokens"), w1.alias("cache_write_1h_tokens"),
        (F.col("write") - F.least(F.col("w5") + F.col("w1"), F.col("write"))).alias("unspecified_write_tokens"), reuse.alias("reuse_bps"), pricing.alias("pricing_coverage"), F.when(F.col("valued") > 0, F.col("impact")).alias("impact_usd_micros"),
    )


def report(events: DataFrame, rules: DataFrame, start: datetime | None, provider: str = "") -> DataFrame:
    """(dimension, label, measures): in total, by source, by model and by project."""
    rows = measured(events, rules, start, provider).select(
        "*", F.concat("provider", F.lit(":"), "source").alias("by_source"), F.concat("provider", F.lit(":"), F.coalesce("model", F.lit("Unknown model"))).alias("by_model"), F.coalesce("project_name", F.lit("Unassigned")).alias("by_project")
    )
    keys = [F.col(k) for k in ("by_source", "by_model", "by_project")]
    groups = rows.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(*_sums(), F.grouping_id().alias("which"))
    label = F.coalesce("by_source", "by_model", "by_project", F.lit("total"))
    dimension = F.when(F.col("which") == 3, "source").when(F.col("which") == 5, "model").when(F.col("which") == 6, "project").otherwise("total")
    return _finished(groups.select("*", dimension.alias("dimension"), label.alias("label")), "dimension", "label")


def by_session(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The summary of every session."""
    keys = ["provider", "source", "native_session_id"]
    return _finished(measured(events, rules, None).groupBy(*keys).agg(*_sums()), *keys)


def shown(report: DataFrame, dimension: str, top: int = 6) -> DataFrame:
    """Rows of a breakdown that used a cache, most read first."""
    rows = report.where((F.col("dimension") == dimension) & ((F.col("cache_read_tokens") > 0) | (F.col("cache_write_tokens") > 0)))
    return rows.orderBy(F.desc("cache_read_tokens"), F.desc_nulls_last("input_context_tokens"), "label").limit(top)


def providers(events: DataFrame, start: datetime | None) -> DataFrame:
    """Providers in range, whatever the provider filter."""
    return events.where(canonical() & since(start)).select("provider").distinct().orderBy("provider")
