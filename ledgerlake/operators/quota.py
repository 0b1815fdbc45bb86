"""Quota pace: robust burn rate and projection of utilisation series.

A series is (provider, window_key, device). Its last stretch without a drop is kept, a
recent or a wider sample chosen, and the slope is the median of all pairs of points
(Theil-Sen) in integers. Series are cut to the newest ``CAP`` readings before the pairs
are made, as a reading loads no more, so pairs per series are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import backoff_seconds

# Fixed values of the pace analysis, in seconds, basis points and readings.
RECENT, EXPANDED, MIN_SPAN, MIN_SAMPLES = 3600, 21_600, 600, 3
JITTER, DROP, STALE, CAP = 50, 500, 900, 512
KEYS = ["provider", "window_key", "device_id"]
#: Days to which a projection without a reset reaches, by kind.
HORIZON_SECONDS = {"rolling": 86_400, "weekly": 8 * 86_400, "model_weekly": 8 * 86_400, "monthly": 32 * 86_400}
#: Median of the integer basis points an hour of all pairs of points (at, high) of an array p, 0 at least; SQL.
_PAIRS = "flatten(transform(p, (a, i) -> transform(filter(slice(p, i + 2, size(p)), b -> b.at > a.at), b -> (b.high - a.high) * 3600 div (b.at - a.at))))"
_MIDDLE = "CASE WHEN size(s) = 0 THEN NULL WHEN size(s) % 2 = 1 THEN s[size(s) div 2] ELSE (s[size(s) div 2 - 1] + s[size(s) div 2]) div 2 END"


def loaded(readings: DataFrame, windows: DataFrame) -> DataFrame:
    """The newest CAP readings of each window's current period up to its observation, then one per instant."""
    w = windows.select(*KEYS, F.col("observed_at").alias("now"), F.col("period_starts_at").alias("w_start"), F.col("resets_at").alias("w_reset"))
    same = (F.col("period_starts_at").eqNullSafe(F.col("w_start"))) & (F.col("resets_at").eqNullSafe(F.col("w_reset")))
    begin = F.coalesce("w_start", F.col("now") - F.expr("INTERVAL '6' HOUR"))
    rows = readings.join(w, KEYS).where(same & F.col("observed_at").between(begin, F.col("now")))
    latest = Window.partitionBy(*KEYS).orderBy(F.desc("observed_at"), F.desc("updated_at"), F.desc("utilization_bps"))
    rows = rows.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= CAP)
    return rows.withColumn("_same", F.lag("observed_at").over(latest)).where(~F.col("observed_at").eqNullSafe(F.col("_same"))).drop("_r", "_same")


def sampled(rows: DataFrame) -> DataFrame:
    """The readings from which the pace is taken, with their running maximum."""
    series = Window.partitionBy(*KEYS)
    ordered = series.orderBy("observed_at")
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    drop = F.coalesce(F.lag("utilization_bps").over(ordered) - F.col("utilization_bps") > DROP, F.lit(False))
    rows = rows.withColumn("_drop", drop).withColumn("_part", F.sum(F.col("_drop").cast("int")).over(before))
    rows = rows.withColumn("_last", F.max("_part").over(series)).where("_part = _last")
    age = F.expr("timestampdiff(SECOND, observed_at, now)")
    recent = age <= RECENT
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', observed_at)")
    rows = rows.withColumns({"at": at, "_recent": recent, "_wide": age <= EXPANDED})
    enough = (F.count_if("_recent").over(series) >= MIN_SAMPLES) & (F.max(F.when(F.col("_recent"), F.col("at"))).over(series) - F.min(F.when(F.col("_recent"), F.col("at"))).over(series) >= MIN_SPAN)
    rows = rows.withColumn("_enough", enough).where(F.when(F.col("_enough"), F.col("_recent")).otherwise(F.col("_wide")))
    return rows.withColumn("high", F.max("utilization_bps").over(before)).withColumn("step", F.col("utilization_bps") - F.lag("utilization_bps").over(ordered))


def facts(sample: DataFrame) -> DataFrame:
    """What a series' sample says: (KEYS, samples, span_seconds, pairs of neighbours, those that hardly fall, last reading, slope); one grouping, CAP points a series at most."""
    grouped = sample.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("samples"), (F.max("at") - F.min("at")).alias("span_seconds"), F.count("step").alias("_pairs"), F.count_if(F.col("step") >= -JITTER).alias("_monotone"), F.max("observed_at").alias("last_reading"),
        F.array_sort(F.collect_list(F.struct("at", "high"))).alias("p"),
    )
    sloped = grouped.withColumn("s", F.expr(f"array_sort({_PAIRS})"))
    return sloped.withColumn("slope", F.greatest(F.expr(_MIDDLE), F.lit(0)).cast("long")).drop("p", "s")


def pace(readings: DataFrame, windows: DataFrame, now: Column | None = None) -> DataFrame:
    """windows (KEYS, kind, utilization_bps, observed_at, period_starts_at, resets_at, refresh_stale, refresh_status) with pace, projection and status.

    now: when the windows are looked at; a window observed over STALE seconds before is stale. Without it only refresh_stale says so.
    """
    if "refresh_status" not in windows.columns:
        windows = windows.withColumn("refresh_status", F.lit("healthy"))
    old = F.lit(False) if now is None else F.timestamp_diff("SECOND", F.col("observed_at"), now) > STALE
    windows = windows.withColumns({"stale": F.col("refresh_stale") | old, "utilization_bps": F.greatest(F.lit(0), F.least(F.lit(10_000), "utilization_bps")).cast("long")})
    rows = windows.join(facts(sampled(loaded(readings, windows))), KEYS, "left").withColumns({"samples": F.coalesce("samples", F.lit(0)), "span_seconds": F.coalesce("span_seconds", F.lit(0))})
    cap = F.col("kind").isin(*HORIZON_SECONDS)
    enough = (F.col("samples") >= MIN_SAMPLES) & (F.col("span_seconds") >= MIN_SPAN)
    rows = rows.withColumns({
        "cap_bearing": cap, "_enough": enough,
        "monotone_percent": F.when(F.col("_pairs") > 0, F.expr("_monotone * 100 div _pairs")).otherwise(0),
    })
    confidence = (
        F.when(~F.col("_enough"), "insufficient").when(F.col("stale") | (F.col("samples") < 4) | (F.col("span_seconds") < 1800), "low")
        .when((F.col("samples") >= 7) & (F.col("span_seconds") >= RECENT) & (F.col("monotone_percent") >= 80), "high").otherwise("medium")
    )
    elapsed = F.expr("timestampdiff(SECOND, period_starts_at, observed_at)")
    average = F.when(F.col("cap_bearing") & F.col("_enough") & (elapsed >= MIN_SPAN), F.expr("utilization_bps * 3600L div timestampdiff(SECOND, period_starts_at, observed_at)"))
    rows = rows.withColumns({"confidence": confidence, "burn_bps_per_hour": F.when(F.col("_enough"), F.col("slope")), "average_bps_per_hour": average})
    can = F.col("cap_bearing") & ~F.col("stale") & F.col("confidence").isin("medium", "high") & (F.col("utilization_bps") < 10000) & (F.col("burn_bps_per_hour") > 0)
    left = F.expr("(10000 - utilization_bps) * 3600L div burn_bps_per_hour")
    horizon = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in HORIZON_SECONDS.items()))
    rows = rows.withColumn("_left", F.when(can, left)).withColumn("_left", F.when((F.col("_left") > 0) & (F.col("resets_at").isNotNull() | (F.col("_left") <= horizon)), F.col("_left")))
    rows = rows.withColumn("projected_full_at", F.expr("timestampadd(SECOND, cast(_left as int), observed_at)"))
    status = (
        F.when(~F.col("cap_bearing"), "informational").when(F.col("utilization_bps") >= 10000, "limit_reached").when(~F.col("_enough"), "gathering").when(F.col("stale"), "stale")
        .when(F.col("burn_bps_per_hour") == 0, "no_recent_change").otherwise("active")
    )
    before_reset = F.coalesce(F.col("projected_full_at") < F.col("resets_at"), F.lit(False))
    return rows.select(*KEYS, "kind", "utilization_bps", "observed_at", "samples", "span_seconds", "monotone_percent", "confidence", "burn_bps_per_hour", "average_bps_per_hour", "projected_full_at", before_reset.alias("before_reset"), status.alias("status"), "stale", "refresh_status")


def at_risk(paced: DataFrame) -> DataFrame:
    """Windows that bear a cap and are full, or will be before they reset, of providers that were read well and lately."""
    sound = ~F.col("stale") & (F.col("refresh_status") == "healthy") & F.col("kind").isin(*HORIZON_SECONDS)
    return paced.where(sound & ((F.col("status") == "limit_reached") | ((F.col("status") == "active") & F.col("before_reset"))))


def latest(readings: DataFrame) -> DataFrame:
    """The windows of each provider's newest snapshot, whichever device took it; devices are never summed, and windows that vanished do not stay."""
    newest = readings.groupBy("provider").agg(F.max(F.struct("observed_at", "updated_at", "device_id")).alias("n"))
    newest = newest.select("provider", "n.observed_at", "n.updated_at", "n.device_id")
    return readings.join(newest, ["provider", "observed_at", "updated_at", "device_id"], "left_semi")


def state(readings: DataFrame, devices: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Each provider's newest snapshot with its windows, the device that took it, and whether it is stale: there, but not refreshed well since.

    devices: (device_id, friendly_name), where a device may be missing; refreshes: (provider, status).
    """
    rows = latest(readings).groupBy("provider", "device_id", "observed_at").agg(F.array_sort(F.collect_list(F.struct("window_key", "utilization_bps"))).alias("windows"))
    known = refreshes.select("provider", F.col("status").alias("refresh_status")).join(rows, "provider", "full_outer").join(devices, "device_id", "left")
    stale = F.col("windows").isNotNull() & ~F.coalesce(F.col("refresh_status") == "healthy", F.lit(False))
    return known.select("provider", "observed_at", "device_id", "friendly_name", "windows", "refresh_status", stale.alias("stale"))


def bucketed(readings: DataFrame) -> DataFrame:
    """Snapshots of responses (a device's readings of one instant): the last response of every five minutes with the same windows, periods and resets.

    snapshot_id is made of that, row_id of it and the window.
    """
    bucket = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', observed_at) div 300")
    seconds = lambda c: f"coalesce(cast(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', {c}) as string), '0')"
    shape = F.concat("window_key", F.lit(":"), F.expr(seconds("period_starts_at")), F.lit(":"), F.expr(seconds("resets_at")))
    response = Window.partitionBy("provider", "device_id", "observed_at")
    shapes = F.array_join(F.array_sort(F.collect_set(shape).over(response)), "|")  # a response has few windows
    rows = readings.withColumn("bucket", bucket)
    rows = rows.withColumn("snapshot_id", F.sha2(F.concat_ws("|", "provider", "device_id", F.col("bucket").cast("string"), shapes), 256))
    rows = rows.withColumn("row_id", F.sha2(F.concat_ws("|", "snapshot_id", "window_key"), 256))
    order = Window.partitionBy("row_id").orderBy(F.desc("observed_at"), F.desc("updated_at"), F.desc("utilization_bps"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def refresh_state(attempts: DataFrame) -> DataFrame:
    """Latest outcome of each provider, failures since its last success, and when to try again; all aggregates, so no provider's attempts meet in one task."""
    at = F.struct("attempted_at", "attempt_id")
    healthy = attempts.where("status = 'healthy'").groupBy("provider").agg(F.max(at).alias("ok"))
    last = attempts.groupBy("provider").agg(F.max(F.struct("attempted_at", "attempt_id", "status", "retry_after_seconds")).alias("l"))
    since = attempts.where("status <> 'healthy'").join(F.broadcast(healthy), "provider", "left").where(F.col("ok").isNull() | (at > F.col("ok")))  # a row for each provider
    rows = last.join(since.groupBy("provider").agg(F.count(F.lit(1)).alias("failures")), "provider", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    wait = F.when(F.col("failures") > 0, backoff_seconds(F.col("failures"), F.col("l.retry_after_seconds")))
    rows = rows.select("provider", F.col("l.status").alias("status"), F.col("l.attempted_at").alias("attempted_at"), "failures", wait.alias("wait_seconds"))
    return rows.withColumn("retry_at", F.expr("timestampadd(SECOND, cast(wait_seconds as int), attempted_at)"))
