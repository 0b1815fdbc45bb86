"""Landed JSON responses to rows: model inventories and quota readings.

Responses are (response_id, provider, body, received_at). Fields that are not named here
never reach a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent_to_bps, rfc3339

_INSTANCE = "struct<id:string,config:struct<context_length:bigint>>"
_SHARED = "id:string,model:string,name:string,key:string,loaded:boolean,state:string,max_context_window:bigint,loaded_context_length:bigint,context_length:bigint,last_access:double,size:bigint,size_bytes:bigint,params_string:string"
#: Most models of a response that is accepted.
MOST_MODELS = 512


def _is(*providers: str) -> Column:
    return F.col("provider").isin(*providers)


def models(responses: DataFrame) -> DataFrame:
    """(response_id, provider, model, loaded, context_length, size_bytes, parameters, quantization, last_activity_at), one row per model id.

    Four dialects by provider: omlx, ollama, lmstudio, lmstudio_v0. A response with a nameless model or too many is left out.
    """
    entry = f"struct<{_SHARED},quantization:variant,details:struct<parameter_size:string,quantization_level:string>,loaded_instances:array<{_INSTANCE}>>"
    body = F.from_json("body", f"struct<models:array<{entry}>,data:array<{entry}>>")
    rows = responses.withColumn("items", F.when(_is("lmstudio_v0"), body["data"]).otherwise(body["models"]))
    name = lambda m: F.when(_is("ollama"), F.coalesce(m["model"], m["name"])).when(_is("lmstudio"), m["key"]).otherwise(m["id"])
    fine = (F.size("items") <= MOST_MODELS) & ~F.exists("items", lambda m: name(m).isNull())
    rows = rows.where(fine).select("response_id", "provider", "received_at", F.explode("items").alias("m")).withColumn("model", name(F.col("m")))
    contexts = F.array_distinct(F.transform("m.loaded_instances", lambda x: x["config"]["context_length"]))
    agreed = F.when((F.size(contexts) == 1) & contexts[0].isNotNull(), contexts[0])
    quantization = F.when(_is("ollama"), F.col("m.details.quantization_level")).when(_is("lmstudio"), F.try_variant_get("m.quantization", "$.name", "string")).when(_is("lmstudio_v0"), F.try_variant_get("m.quantization", "$", "string"))
    state = F.when(F.col("m.state") == "loaded", F.lit(True)).when(F.col("m.state") == "not-loaded", F.lit(False))
    accessed = F.when((F.col("m.last_access") > 0) & (F.col("m.last_access") <= F.unix_timestamp("received_at")), F.to_utc_timestamp(F.timestamp_seconds(F.floor("m.last_access")), F.current_timezone()).cast("timestamp_ntz"))
    once = Window.partitionBy("response_id", "model").orderBy(F.coalesce("m.params_string", F.lit("")))
    rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    return rows.select(
        "response_id", "provider", "model",
        F.when(_is("omlx"), F.col("m.loaded")).when(_is("ollama"), F.lit(False)).when(_is("lmstudio"), F.size("m.loaded_instances") > 0).otherwise(state).alias("loaded"),
        F.when(_is("omlx"), F.col("m.max_context_window")).when(_is("lmstudio"), agreed).when(_is("lmstudio_v0"), F.col("m.loaded_context_length")).alias("context_length"),
        F.when(_is("ollama"), F.col("m.size")).when(_is("lmstudio"), F.col("m.size_bytes")).alias("size_bytes"),
        F.when(_is("ollama"), F.col("m.details.parameter_size")).when(_is("lmstudio", "lmstudio_v0"), F.col("m.params_string")).alias("parameters"), quantization.alias("quantization"), F.when(_is("omlx"), accessed).alias("last_activity_at"),
    )


def with_running(models: DataFrame, running: DataFrame) -> DataFrame:
    """models with those of running (response_id, model, context_length) loaded; running ones that are missing are added."""
    now = running.select("response_id", "model", F.col("context_length").alias("_context"), F.lit(True).alias("_runs"))
    rows = models.join(now, ["response_id", "model"], "full_outer")
    runs = F.coalesce("_runs", F.lit(False))
    return rows.withColumns({"provider": F.coalesce("provider", F.lit("ollama")), "loaded": F.when(runs, True).otherwise(F.col("loaded")), "context_length": F.when(runs, F.col("_context")).otherwise(F.col("context_length"))}).select(*models.columns)


# Keys and scopes that are no quota of the account, and the order of kinds.
IGNORED_KEYS = ["seven_day_oauth_apps", "seven_day_cowork", "seven_day_omelette", "iguana_necktie", "omelette_promotional"]
UNRELATED_SCOPES = ["oauth_apps", "cowork", "omelette", "iguana_necktie"]
KIND_ORDER = ["rolling", "weekly", "monthly", "model_weekly", "product", "other"]
CONTAINERS = ["limits", "windows", "quota_windows", "scoped_limits"]


def _key(column: Column) -> Column:
    clean = F.regexp_replace(F.substring(column, 1, 80), "[^A-Za-z0-9_-]", "_")
    return F.when(clean != "", clean)


def _scope(column: Column) -> Column:
    clean = F.substring(F.regexp_replace(column, "[^A-Za-z0-9_-]", ""), 1, 80)
    return F.when(clean != "", clean)


def humanised(column: Column) -> Column:
    """Parts between underscores and hyphens, each with a capital first letter."""
    parts = F.filter(F.split(column, "[_-]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))), " ")


def _field(entry: Column, *names: str) -> Column:
    """The first of the fields that is a string with something in it."""
    values = [F.trim(F.when(F.schema_of_variant(F.try_variant_get(entry, f"$.{n}", "variant")) == "STRING", F.try_variant_get(entry, f"$.{n}", "string"))) for n in names]
    return F.coalesce(*(F.when(v != "", v) for v in values))


def _number(entry: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(entry, path, "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(entry, path, "double"))


def flat_and_dynamic_windows(responses: DataFrame) -> DataFrame:
    """(response_id, key, label, kind, scope, utilization_bps, resets_at) of responses whose windows are keys, or items of containers; first of equal keys."""
    root = responses.select("response_id", F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    top = root.select("response_id", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "entry"))
    flat = top.where((F.col("name").isin("five_hour", "seven_day") | F.col("name").startswith("seven_day_")) & ~F.col("name").isin(*IGNORED_KEYS))
    model = F.when(F.col("name").startswith("seven_day_"), F.substring("name", 11, 1000))
    flat = flat.withColumn("scope", model).where(F.col("scope").isNull() | ((F.col("scope") != "") & ~F.col("scope").isin(*UNRELATED_SCOPES)))
    flat = flat.select(
        "response_id", "entry", F.col("name").alias("key"), F.when(F.col("name") == "five_hour", "5-hour").when(F.col("name") == "seven_day", "Weekly").otherwise(humanised(F.col("scope"))).alias("label"),
        F.when(F.col("name") == "five_hour", "rolling").when(F.col("name") == "seven_day", "weekly").otherwise("model_weekly").alias("kind"), "scope", F.lit(0).alias("place"),
    )
    held = top.where(F.col("name").isin(*CONTAINERS))
    listed = held.select("response_id", F.posexplode(F.try_variant_get("entry", "$", "array<variant>")).alias("n", "entry")).select("response_id", "n", F.lit(None).cast("string").alias("name"), "entry")
    mapped = held.where(F.schema_of_variant("entry").startswith("OBJECT")).select("response_id", F.posexplode(F.try_variant_get("entry", "$", "map<string,variant>")).alias("n", "name", "entry"))
    items = listed.unionByName(mapped).withColumns({"scope": _field(F.col("entry"), "scope", "model", "model_scope"), "raw": _field(F.col("entry"), "kind", "type", "period")})
    key = F.coalesce(_field(F.col("entry"), "key", "id", "name"), "name", F.concat(F.lit("weekly_"), "scope"), F.concat(F.lit("dynamic_"), "n"))
    items = items.withColumn("key", key).where((F.col("key") != "seven_day_oauth_apps") & (F.col("scope").isNull() | ~F.col("scope").isin(*UNRELATED_SCOPES)))
    kind = (
        F.when(F.col("raw").isin("rolling", "five_hour"), "rolling").when(F.col("raw").isin("weekly", "seven_day") & F.col("scope").isNull(), "weekly")
        .when(F.col("raw").isin("model_weekly", "model", "scoped_weekly") | F.col("scope").isNotNull(), "model_weekly").otherwise("other")
    )
    items = items.select("response_id", "entry", "key", humanised(F.coalesce("scope", "key")).alias("label"), kind.alias("kind"), "scope", (F.col("n") + 1).alias("place"))
    rows = flat.unionByName(items).withColumns({"utilization_bps": percent_to_bps(_number(F.col("entry"), "$.utilization")), "key": _key(F.col("key"))}).where("utilization_bps IS NOT NULL AND key IS NOT NULL")
    once = Window.partitionBy("response_id", "key").orderBy(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), "place")
    rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    return rows.select("response_id", "key", "label", "kind", _scope(F.col("scope")).alias("scope"), "utilization_bps", rfc3339(_field(F.col("entry"), "resets_at")).alias("resets_at"))


def _cents(path: str) -> Column:
    value = F.when(F.schema_of_variant(F.try_variant_get("c", f"{path}.val", "variant")) == "BIGINT", F.try_variant_get("c", f"{path}.val", "bigint"))
    return F.when(value >= 0, value)


def billing_windows(responses: DataFrame) -> DataFrame:
    """(response_id, key, kind, utilization_bps, period_starts_at, resets_at) of billing responses: pool or legacy month, and products."""
    rows = responses.select("response_id", F.try_variant_get(F.try_parse_json("body"), "$.config", "variant").alias("c")).where("c IS NOT NULL")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("c", path, "variant")) == "STRING", F.try_variant_get("c", path, "string"))
    rows = rows.withColumns({"pool": _number(F.col("c"), "$.creditUsagePercent"), "type": text("$.currentPeriod.type"), "limit": _cents("$.monthlyLimit"), "used": _cents("$.used")})
    weekly, monthly = F.col("type") == "USAGE_PERIOD_TYPE_WEEKLY", F.col("type") == "USAGE_PERIOD_TYPE_MONTHLY"
    pools = rows.where("pool IS NOT NULL AND type IS NOT NULL").select(
        "response_id", F.when(weekly, "weekly_pool").when(monthly, "monthly_pool").otherwise("credits_pool").alias("key"), F.when(weekly, "weekly").when(monthly, "monthly").otherwise("other").alias("kind"),
        percent_to_bps(F.col("pool")).alias("utilization_bps"), rfc3339(text("$.currentPeriod.start")).alias("period_starts_at"), rfc3339(text("$.currentPeriod.end")).alias("resets_at"),
    )
    legacy = rows.where("pool IS NULL AND limit > 0 AND used <= limit").select(
        "response_id", F.lit("monthly_credits").alias("key"), F.lit("monthly").alias("kind"), F.expr("CAST(used * 10000 div limit AS INT)").alias("utilization_bps"), rfc3339(text("$.billingPeriodStart")).alias("period_starts_at"), rfc3339(text("$.billingPeriodEnd")).alias("resets_at"),
    )
    products = rows.select("response_id", F.explode(F.try_variant_get("c", "$.productUsage", "array<variant>")).alias("p")).withColumn("product", _field(F.col("p"), "product")).where("product IS NOT NULL")
    products = products.select(
        "response_id", F.concat(F.lit("product_"), _key(F.col("product"))).alias("key"), F.lit("product").alias("kind"), percent_to_bps(_number(F.col("p"), "$.usagePercent")).alias("utilization_bps"), F.lit(None).cast("timestamp_ntz").alias("period_starts_at"), F.lit(None).cast("timestamp_ntz").alias("resets_at"),
    )
    return pools.unionByName(legacy).unionByName(products).where("utilization_bps IS NOT NULL")


def extra_usage(responses: DataFrame) -> DataFrame:
    """(response_id, enabled, limit, used, prepaid, utilization_bps) of pay-as-you-go use, in minor units."""
    rows = responses.select("response_id", F.try_variant_get(F.try_parse_json("body"), "$.config", "variant").alias("c")).where("c IS NOT NULL")
    rows = rows.select("response_id", _cents("$.onDemandCap").alias("limit"), _cents("$.onDemandUsed").alias("used"), _cents("$.prepaidBalance").alias("prepaid")).where("coalesce(limit, used, prepaid) IS NOT NULL")
    return rows.withColumns({"enabled": F.expr("coalesce(limit, 0) > 0 OR coalesce(used, 0) > 0"), "utilization_bps": F.expr("CASE WHEN limit > 0 AND used <= limit THEN used * 10000 div limit END")})


def claude_extra_usage(responses: DataFrame) -> DataFrame:
    """(response_id, enabled, limit, used, utilization_bps, currency) of responses that say whether extra use is on; in minor units, currencies of 3 to 8 letters."""
    rows = responses.select("response_id", F.try_variant_get(F.try_parse_json("body"), "$.extra_usage", "variant").alias("e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    flag = F.when(F.schema_of_variant(F.try_variant_get("e", "$.is_enabled", "variant")) == "BOOLEAN", F.try_variant_get("e", "$.is_enabled", "boolean"))
    currency = F.upper(F.trim(F.when(F.schema_of_variant(F.try_variant_get("e", "$.currency", "variant")) == "STRING", F.try_variant_get("e", "$.currency", "string"))))

    def whole(path: str) -> Column:
        number = _number(F.col("e"), path)
        return F.when((number >= 0) & (number < 2.0**63), F.round(number).cast("long"))

    found = rows.withColumns({"enabled": flag, "limit": whole("$.monthly_limit"), "used": whole("$.used_credits"), "utilization_bps": percent_to_bps(_number(F.col("e"), "$.utilization")), "currency": F.when(currency.rlike("^[A-Z]{3,8}$"), currency)})
    return found.where("enabled IS NOT NULL").drop("e")
