"""Local runtimes: inventories, polls and the transitions between them.

A poll is (device_id, provider, observed_at, status, models), status healthy, unavailable
or not_detected, models an array of structs with id and loaded, which is null where the runtime does not say.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical

#: Seconds after which a poll says nothing any more; days and rows for which observations are kept.
STALE_SECONDS, KEEP_DAYS, KEEP_ROWS = 120, 90, 10_000
KEYS = ["device_id", "provider"]


def transitions(polls: DataFrame) -> DataFrame:
    """(KEYS, observed_at, state, model): what each poll changed against the one before."""
    order = Window.partitionBy(*KEYS).orderBy("observed_at")
    healthy = F.col("status") == "healthy"
    ids = lambda kind: F.when(healthy, F.transform(F.filter("models", kind), lambda m: m["id"])).otherwise(F.array().cast("array<string>"))
    # A model is unloaded if the runtime says so or lists it no more, not if it says nothing.
    rows = polls.withColumns({"healthy": healthy, "loaded": ids(lambda m: m["loaded"]), "may_be_loaded": ids(lambda m: F.coalesce(m["loaded"], F.lit(True)))})
    gap = F.expr("timestampdiff(SECOND, before_at, observed_at)")
    rows = rows.withColumns({"before": F.lag("status").over(order), "before_at": F.lag("observed_at").over(order), "before_loaded": F.lag("loaded").over(order)})
    rows = rows.withColumn("fresh", F.coalesce((gap <= STALE_SECONDS) & (F.col("before") == "healthy"), F.lit(False)))
    empty = F.array().cast("array<string>")
    known = F.coalesce("before_loaded", empty)
    server = F.when(F.col("healthy") & ~F.col("fresh"), F.array(F.lit("server_online"))).when(F.col("fresh") & (F.col("status") == "unavailable"), F.array(F.lit("server_unavailable"))).otherwise(empty)
    pairs = lambda state, models: F.transform(models, lambda m: F.struct(F.lit(state).alias("state"), m.alias("model")))
    changes = F.concat(
        F.transform(server, lambda s: F.struct(s.alias("state"), F.lit(None).cast("string").alias("model"))),
        F.when(F.col("healthy"), pairs("model_loaded", F.array_except("loaded", known))).otherwise(F.array().cast("array<struct<state:string,model:string>>")),
        F.when(F.col("healthy"), pairs("model_unloaded", F.array_except(known, F.col("may_be_loaded")))).otherwise(F.array().cast("array<struct<state:string,model:string>>")),
    )
    return rows.select(*KEYS, "observed_at", F.explode(changes).alias("c")).select(*KEYS, "observed_at", "c.state", "c.model")


def retained(observations: DataFrame, now: datetime) -> DataFrame:
    """Observations of the last KEEP_DAYS days, the newest KEEP_ROWS of each device."""
    rows = observations.where(F.col("observed_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{KEEP_DAYS}' DAY"))
    order = Window.partitionBy("device_id").orderBy(F.desc("observed_at"), "provider", "state", "model")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= KEEP_ROWS).drop("_r")


#: Statuses that say nothing of the models but that the runtime was configured anew.
RESET = ["not_detected", "disabled"]


def sightings(polls: DataFrame) -> DataFrame:
    """(KEYS, model, first_seen, last_seen, last_loaded): the stretches of lists in which a model stood. A list without it, or a configuration, ends a stretch; failed polls do not."""
    lists = polls.where((F.col("status") == "healthy") | F.col("status").isin(RESET)).withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("observed_at")))
    rows = lists.where("status = 'healthy'").select(*KEYS, "observed_at", "_n", F.explode("models").alias("m"))
    rows = rows.groupBy(*KEYS, F.col("m.id").alias("model"), "observed_at", "_n").agg(F.max(F.coalesce("m.loaded", F.lit(False))).alias("loaded"))
    stretch = F.col("_n") - F.row_number().over(Window.partitionBy(*KEYS, "model").orderBy("_n"))
    return rows.withColumn("_s", stretch).groupBy(*KEYS, "model", "_s").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.max(F.when(F.col("loaded"), F.col("observed_at"))).alias("last_loaded")).drop("_s")


def first_seen(polls: DataFrame) -> DataFrame:
    """Since when each model has been listed without a break (as of its last list), when it was listed last, and when it was last loaded."""
    newest = F.max(F.struct("last_seen", "first_seen")).alias("n")
    return sightings(polls).groupBy(*KEYS, "model").agg(newest, F.max("last_loaded").alias("last_loaded")).select(*KEYS, "model", "n.first_seen", "n.last_seen", "last_loaded")


def shown_status(now: Column) -> Column:
    """Of a poll (status, observed_at): a healthy one that is old at ``now``, or from the future, is stale."""
    age = F.timestamp_diff("SECOND", F.col("observed_at"), now)
    return F.when((F.col("status") == "healthy") & ~age.between(0, STALE_SECONDS), "stale").otherwise(F.col("status"))


def counts(polls: DataFrame, now: Column, settings: DataFrame | None = None) -> DataFrame:
    """Reachable runtimes and loaded models by device: of each enabled runtime's last poll, if it is healthy and not stale at ``now``.

    settings: (device_id, provider, enabled); a runtime that is not there is enabled.
    """
    last = polls.groupBy(*KEYS).agg(F.max_by(F.struct("status", "models"), "observed_at").alias("p"), F.max("observed_at").alias("observed_at")).withColumn("status", F.col("p.status"))
    if settings is None:
        last = last.withColumn("enabled", F.lit(True))
    else:
        last = last.join(settings.select(*KEYS, "enabled"), KEYS, "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    up = F.col("enabled") & (shown_status(now) == "healthy")
    loaded = F.when(F.col("_up"), F.size(F.filter("p.models", lambda m: m["loaded"]))).otherwise(0)
    return last.withColumn("_up", up).groupBy("device_id").agg(F.count_if("_up").alias("reachable"), F.sum(loaded).alias("loaded_models"))


def local_snapshot(events: DataFrame, details: DataFrame, observations: DataFrame, day_start: datetime, device: str, history_available: bool = True) -> DataFrame:
    """Tokens and requests that this device's runtime counted since the day began, and observations since then.

    details: (event_id, requests) of hourly rows. Requests are null where the history cannot be read.
    """
    begin = F.lit(day_start).cast("timestamp_ntz")
    hourly = canonical() & (F.col("provider") == "omlx") & (F.col("source") == "omlx_usage_hourly") & (F.col("device_id") == device) & (F.col("occurred_at") >= begin)
    rows = events.where(hourly).join(details.select(F.col("event_id").alias("id"), "requests"), "id", "left")
    usage = rows.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens_today"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests_today"))
    seen = observations.where(F.col("observed_at") >= begin).agg(F.count(F.lit(1)).alias("observations_today"))
    requests = F.when(F.lit(history_available), F.col("requests_today")).alias("requests_today")
    return usage.crossJoin(F.broadcast(seen)).select("tokens_today", requests, "observations_today")  # two rows of one each
