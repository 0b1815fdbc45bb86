"""Inputs of the quota, merge and runtime operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hashed
from .ledger import NOW, PROVIDERS, ledger, table

KINDS = ["rolling", "weekly", "product", "other", "monthly"]


def quota_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation that grows over each day, for five windows; the device is the day at which a reading is looked at.

    The last window has no period, and its readings are also seen by the next day's device.
    """
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("w"), (F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL '945' DAY")).alias("observed_at"), "event_id", F.floor(F.col("value") * 3).cast("long").alias("used"))
    rows = rows.withColumn("day", F.col("observed_at").cast("date"))
    so_far = Window.partitionBy("w", "day").orderBy("observed_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("utilization_bps", F.least(F.lit(10000), F.sum("used").over(so_far)).cast("long"))
    seen = F.explode(F.when(F.col("w") == 4, F.array("day", F.date_add("day", 1))).otherwise(F.array("day")))
    rows = rows.select("*", seen.alias("seen"))
    period = F.when(F.col("w") < 4, F.col("seen").cast("timestamp_ntz"))
    return rows.select(
        F.lit("claude").alias("provider"), F.concat(F.lit("w"), "w").alias("window_key"), F.concat(F.lit("day-"), F.date_format("seen", "yyyyMMdd")).alias("device_id"), "observed_at", F.col("observed_at").alias("updated_at"),
        "utilization_bps", period.alias("period_starts_at"), (period + F.expr("INTERVAL '1' DAY")).alias("resets_at"), F.col("seen").cast("timestamp_ntz").alias("looked_from"), "w",
    )


def quota_windows(readings: DataFrame) -> DataFrame:
    """The state of each window at 18:00 (of the last one at 03:00) of each day; the third is a model's weekly one every other day."""
    hours = F.when(F.col("w") == 4, F.expr("INTERVAL '3' HOUR")).otherwise(F.expr("INTERVAL '18' HOUR"))
    rows = readings.withColumn("at", F.col("looked_from") + hours).where("observed_at <= at AND observed_at >= looked_from - INTERVAL '3' HOUR")
    last = rows.groupBy("provider", "window_key", "device_id", "w", "at", "period_starts_at", "resets_at").agg(F.max_by("utilization_bps", "observed_at").alias("utilization_bps"))
    kind = F.when((F.col("w") == 2) & (F.dayofmonth("at") % 2 == 0), "model_weekly").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("w") + 1).cast("int")))
    return last.select(
        "provider", "window_key", "device_id", kind.alias("kind"), "utilization_bps", F.col("at").alias("observed_at"),
        "period_starts_at", "resets_at", (F.dayofmonth("at") % 7 == 0).alias("refresh_stale"), F.when(F.dayofmonth("at") % 5 == 0, "error").otherwise("healthy").alias("refresh_status"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative revisions of requests over ``lineitem``, whose (order, line) repeats."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("native_session_id"), F.concat(F.lit("line:"), "l_linenumber").alias("native_event_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("occurred_at"),
        F.expr("CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE concat('model-', l_suppkey % 7) END").alias("model"), F.expr("CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('Project-', l_partkey % 8) END").alias("project_name"),
        F.lit(0).cast("long").alias("cache_write_5m_tokens"), F.lit(0).cast("long").alias("cache_write_1h_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"), F.floor("l_extendedprice").cast("long").alias("total_tokens"),
        F.lit(None).cast("long").alias("native_cost_usd_ticks"), F.col("l_shipdate").cast("timestamp_ntz").alias("updated_at"), F.lit("synced").alias("sync_status"), (F.col("l_suppkey") % 2).alias("half"),
    )
    return rows.withColumn("id", hashed(F.lit("claude"), F.col("native_session_id"), F.col("native_event_id")))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of 25 devices' runtimes, 51 to 150 seconds apart, over ``events``; some do not say what is loaded."""
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("device").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("device"), "ts", "event_id", "event_type", k.alias("k")).withColumn("n", F.row_number().over(order))
    model = lambda prefix, m: F.struct(F.concat(F.lit(prefix), F.col("k") % m).alias("id"), F.when(F.col("k") % m == 1, False).when(F.col("k") % 7 != 3, True).alias("loaded"))
    return rows.select(
        F.concat(F.lit("device-"), "device").alias("device_id"), F.lit("omlx").alias("provider"), F.expr("timestampadd(SECOND, cast(n * 100 + k % 50 as int), TIMESTAMP_NTZ '2026-09-01 00:00:00')").alias("observed_at"),
        F.expr("CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'not_detected' ELSE 'healthy' END").alias("status"), F.array(model("a", 3), model("b", 4)).alias("models"),
    )


def codex_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a session log for each codex session of the ledger, one line of context and one of usage per measured row."""
    rows = ledger(spark, sf_dir).where("provider = 'codex' AND measurement_kind = 'measured'")
    number = F.substring_index("native_event_id", ":", -1).cast("long")
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("t"), number).alias("turn_id"), "model", F.concat(F.lit("/work/"), "project_name").alias("cwd")).alias("payload")))
    usage = F.struct("input_tokens", "cached_input_tokens", F.col("cache_write_tokens").alias("cache_write_input_tokens"), "output_tokens", F.col("reasoning_tokens").alias("reasoning_output_tokens"), "total_tokens")
    count = F.to_json(F.struct(
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), number.alias("ordinal"), F.lit("event_msg").alias("type"),
        F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info")).alias("payload"),
    ))
    lines = rows.groupBy("native_session_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "native_event_id", F.concat(turn, F.lit("\n"), count).alias("text")))).alias("l"))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("native_session_id").alias("id")).alias("payload")))
    return lines.select(F.concat(F.lit("/logs/"), "native_session_id", F.lit(".jsonl")).alias("path"), F.concat(meta, F.lit("\n{broken\n"), F.array_join("l.text", "\n"), F.lit("\n")).alias("content"))


def claude_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a log for each order of ``lineitem``, whose repeated lines are revisions of a request."""
    record = F.struct("l_linenumber", "l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.floor("l_extendedprice").cast("long").alias("input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"))
    # Texts are made after records have met: they are several times as large.
    line = lambda r: F.to_json(F.struct(
        F.lit("assistant").alias("type"), F.concat(F.lit("order-"), "l_orderkey").alias("sessionId"), F.concat(F.lit("r"), r["l_linenumber"]).alias("requestId"), F.date_format(r["at"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(F.concat(F.lit("claude-"), r["l_suppkey"] % 3).alias("model"), F.struct(r["input_tokens"].alias("input_tokens"), r["output_tokens"].alias("output_tokens")).alias("usage")).alias("message"),
    ))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(record)).alias("l"))
    return lines.select(F.concat(F.lit("/logs/"), "l_orderkey", F.lit(".jsonl")).alias("path"), F.array_join(F.transform("l", line), "\n").alias("content"))


def grok_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a log for each Grok session and project of the ledger, whose turns are written in three dialects, and one broken line each."""
    rows = ledger(spark, sf_dir).where("provider = 'grok' AND measurement_kind = 'measured'").withColumn("project_name", F.coalesce("project_name", F.lit("Unfiled")))
    n = F.substring_index("native_event_id", ":", -1).cast("long")
    at = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    first = F.to_json(F.struct(at.alias("timestamp"), F.struct(
        F.col("native_session_id").alias("sessionId"), F.concat(F.lit("/w/"), "project_name").alias("cwd"),
        F.struct(F.lit("turn_completed").alias("sessionUpdate"), n.cast("string").alias("promptId"), F.lit("one").alias("modelId"), F.struct(
            F.col("input_tokens").alias("inputTokens"), F.col("cached_input_tokens").alias("cachedReadTokens"), F.col("output_tokens").alias("outputTokens"), F.col("total_tokens").alias("totalTokens"),
            F.col("native_cost_usd_ticks").alias("costUsdTicks"), (n % 5 == 0).alias("costIsPartial")).alias("usage")).alias("update")).alias("params")))
    second = F.to_json(F.struct(F.col("native_session_id").alias("session_id"), F.concat(F.lit("C:\\w\\"), "project_name").alias("project"), F.struct(
        F.lit("turn_completed").alias("sessionUpdate"), n.cast("string").alias("turn_id"), at.alias("timestamp"), F.struct(
            F.col("input_tokens").alias("prompt_tokens"), F.col("cached_input_tokens").alias("cache_read_input_tokens"), F.col("output_tokens").alias("completion_tokens"), F.lit("two").alias("model")).alias("usage")).alias("update")))
    millis = F.expr("cast(unix_millis(cast(occurred_at as timestamp)) as string)")
    third = F.to_json(F.struct(F.struct(F.struct(millis.alias("agentTimestampMs")).alias("_meta"), F.struct(
        F.lit("turn_completed").alias("sessionUpdate"), F.struct(F.lit(7).alias("costUsdTicks"), F.struct(
            F.struct(F.col("input_tokens").alias("inputTokens")).alias("b"), F.struct(F.col("output_tokens").alias("output_tokens"), F.lit(3).alias("costUsdTicks")).alias("a")).alias("modelUsage")).alias("usage")).alias("update")).alias("params")))
    text = F.when(n % 3 == 0, first).when(n % 3 == 1, second).otherwise(third)
    lines = rows.groupBy("native_session_id", "project_name").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "native_event_id", text.alias("text")))).alias("l"))
    path = F.concat(F.lit("/home/sessions/%2Fw%2F"), "project_name", F.lit("/"), "native_session_id", F.lit("/updates.jsonl"))
    return lines.select(path.alias("path"), F.concat(F.lit("{broken\n"), F.array_join("l.text", "\n"), F.lit("\n")).alias("content"))


def gemini_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a document for each Gemini session of the ledger, whose records are written in two dialects; every ninth has no usage."""
    rows = ledger(spark, sf_dir).where("provider = 'gemini' AND measurement_kind = 'measured'")
    n = F.substring_index("native_event_id", ":", -1).cast("long")
    at = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    first = F.to_json(F.struct(at.alias("createdAt"), F.concat(F.lit("m"), n).alias("messageId"), F.lit("turn").alias("turnId"), "model", F.concat(F.lit("/p/"), "project_name").alias("cwd"), F.struct(
        F.col("input_tokens").alias("promptTokenCount"), F.col("cached_input_tokens").alias("cachedContentTokenCount"), F.col("output_tokens").alias("candidatesTokenCount"), F.col("reasoning_tokens").alias("thoughtsTokenCount")).alias("usageMetadata")))
    usage = F.struct("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")
    second = F.to_json(F.struct(at.alias("timestamp"), F.concat(F.lit("i"), n).alias("id"), F.lit("x").alias("messageId"), F.lit("own").alias("session_id"), F.when(n % 9 == 1, None).otherwise(F.struct("model", usage.alias("usageMetadata"))).alias("response")))
    lines = rows.groupBy("native_session_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "native_event_id", F.when(n % 2 == 0, first).otherwise(second).alias("text")))).alias("l"))
    content = F.concat(F.lit('{"sessionId": "'), "native_session_id", F.lit('", "events": ['), F.array_join("l.text", ", "), F.lit("]}"))
    return lines.select(F.concat(F.lit("/logs/"), "native_session_id", F.lit(".json")).alias("path"), content.alias("content"))


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for every brand and ten thousand parts of ``part``, the parts being the models of a runtime."""
    entry = F.struct(F.concat(F.lit("part-"), "p_partkey").alias("key"), F.col("p_size").cast("long").alias("size_bytes"), F.col("p_type").alias("params_string"), F.expr("transform(slice(array(1, 2), 1, cast(p_partkey % 3 as int)), i -> named_struct('id', cast(i as string), 'config', named_struct('context_length', p_size * if(p_partkey % 2 = 0, 1, i))))").alias("instances"))
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.expr("p_partkey div 10000")).alias("response_id"), entry.alias("e"))
    body = F.to_json(F.struct(F.transform(F.collect_list("e"), lambda e: F.struct(e["key"].alias("key"), e["size_bytes"].alias("size_bytes"), e["params_string"].alias("params_string"), e["instances"].alias("loaded_instances"))).alias("models")))
    return rows.groupBy("response_id").agg(body.alias("body")).select("response_id", F.lit("lmstudio").alias("provider"), "body", F.lit(NOW).cast("timestamp_ntz").alias("received_at"))


def quota_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota response for each customer: a flat window, a list of limits by nation, and extra usage."""
    body = F.to_json(F.struct(
        F.struct((F.col("c_custkey") % 1000 / 8.0).alias("utilization"), F.lit("2026-09-06T04:00:00Z").alias("resets_at")).alias("five_hour"),
        F.array(F.struct(F.concat(F.lit("model_"), F.col("c_nationkey")).alias("scope"), (F.col("c_custkey") % 101).cast("double").alias("utilization"))).alias("limits"),
        F.struct(
            F.when(F.col("c_custkey") % 9 != 4, F.col("c_custkey") % 2 == 0).alias("is_enabled"), (F.col("c_custkey") % 700 - 10).alias("monthly_limit"), (F.col("c_custkey") % 300 / 4.0).alias("used_credits"),
            (F.col("c_custkey") % 130 / 1.0).alias("utilization"), F.when(F.col("c_custkey") % 3 == 0, " usd ").otherwise("e2").alias("currency")).alias("extra_usage"),
    ))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("response_id"), F.lit("claude").alias("provider"), body.alias("body"), F.lit(NOW).cast("timestamp_ntz").alias("received_at"))


def billing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legacy billing response for each customer."""
    cents = lambda c: F.struct(c.cast("long").alias("val"))
    config = F.struct(cents(F.col("c_custkey") % 500 + 1).alias("monthlyLimit"), cents(F.col("c_custkey") % 300).alias("used"), F.lit("2026-08-01T00:00:00Z").alias("billingPeriodStart"), cents(F.col("c_custkey") % 7).alias("onDemandCap"), cents(F.col("c_custkey") % 5).alias("onDemandUsed"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("response_id"), F.lit("grok").alias("provider"), F.to_json(F.struct(config.alias("config"))).alias("body"), F.lit(NOW).cast("timestamp_ntz").alias("received_at"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions over ``customer``."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("provider"), (F.col("c_custkey") * 37 % 20_000).alias("price_cents"), F.expr("if(c_custkey % 4 = 0, 'annual', 'monthly')").alias("cadence"), (F.col("c_nationkey") % 3 != 0).alias("active"))


def refresh_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of quota refreshes over ``orders``: a series per order priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("attempted_at"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'healthy' ELSE 'error' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 9000 END").alias("retry_after_seconds"),
    )
