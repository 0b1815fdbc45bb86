"""Valuing events with effective-dated, tiered rules in exact integer money.

The catalogue has a fixed size (39 rows), so each provider's rules are one array that is
broadcast; on each event the best rule is a filter and a maximum over some ten structs.
The fact side is read once, and is neither multiplied, grouped nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cost

#: Fields that rank matching rules come first in the struct, so that the greatest struct is the best rule.
_RANK = "model = r.model_pattern AS exact, length(r.model_pattern) AS size, r.effective_from AS effective_from, r.min_input AS min_input, r.version AS version"
_RATES = ["max_input", "input_semantics", "input_rate", "cached_rate", "output_rate", "write_5m_rate", "write_1h_rate", "reasoning_rate", "reasoning_behavior"]


def with_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with rule, the struct of the rule that prices them, null where none does."""
    listed = rules.groupBy("provider").agg(F.collect_list(F.struct("model_pattern", "effective_from", "min_input", "version", *_RATES)).alias("_rules"))
    best = F.expr(f"""array_max(transform(filter(_rules, r -> r.effective_from <= occurred_at
        AND (model = r.model_pattern OR (r.model_pattern LIKE '%*' AND startswith(model, left(r.model_pattern, length(r.model_pattern) - 1))))
        AND input_tokens + if(r.input_semantics = 'cache_additive', cached_input_tokens + cache_write_tokens, 0) BETWEEN r.min_input AND coalesce(r.max_input, 9223372036854775807)),
        r -> struct({_RANK}, {", ".join(f"r.{c} AS {c}" for c in _RATES)})))""")
    return events.join(F.broadcast(listed), "provider", "left").withColumn("rule", best).select(*events.columns, "rule")


def with_stored_model(events: DataFrame, stored: DataFrame) -> DataFrame:
    """events whose missing models are those of the stored row of the very same identity, unless it is superseded; before they are priced."""
    same = ["id", "provider", "source", "source_type", "native_session_id", "native_event_id", "device_id", "measurement_kind"]
    known = stored.where("superseded_by_event_id IS NULL AND model IS NOT NULL").select(*same, F.col("model").alias("_model")).dropDuplicates(same)
    return events.join(known, same, "left").withColumn("model", F.coalesce("model", "_model")).select(*events.columns)


_W5 = "least(cache_write_5m_tokens, cache_write_tokens)"
_W1 = f"least(cache_write_1h_tokens, cache_write_tokens - {_W5})"
_FRESH = "if(rule.input_semantics = 'cache_included', greatest(0, input_tokens - cached_input_tokens - cache_write_tokens), input_tokens)"


def priced(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with estimated_api_value_usd_micros and pricing_status set anew."""
    parts = [cost(_FRESH, "rule.input_rate"), cost("output_tokens", "rule.output_rate")]
    parts += [cost(t, f"rule.{r}") for t, r in (("cached_input_tokens", "cached_rate"), (_W5, "write_5m_rate"), (_W1, "write_1h_rate"))]
    parts.append(f"CASE WHEN rule.reasoning_behavior = 'separate' THEN {cost('reasoning_tokens', 'rule.reasoning_rate')} END")
    value = " + ".join(f"coalesce({p}, 0)" for p in parts)
    partial = f"""(cached_input_tokens > 0 AND rule.cached_rate IS NULL) OR ({_W5} > 0 AND rule.write_5m_rate IS NULL) OR ({_W1} > 0 AND rule.write_1h_rate IS NULL)
        OR cache_write_tokens - {_W5} - {_W1} > 0 OR (rule.reasoning_behavior = 'unavailable' AND reasoning_tokens > 0)
        OR (rule.reasoning_behavior = 'separate' AND reasoning_tokens > 0 AND rule.reasoning_rate IS NULL)"""
    status = F.expr(f"CASE WHEN rule IS NULL THEN 'unavailable' WHEN {partial} THEN 'partial' ELSE 'available' END")
    return with_rule(events, rules).withColumns({"estimated_api_value_usd_micros": F.expr(f"CASE WHEN rule IS NOT NULL THEN {value} END"), "pricing_status": status}).select(*events.columns)


def with_cache_impact(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with what caching saved (or cost) in micros, and its pricing; null where the row used no cache."""
    parts = [("cached_input_tokens", "cached_rate"), (_W5, "write_5m_rate"), (_W1, "write_1h_rate")]
    saved = " + ".join(f"CASE WHEN {t} > 0 AND rule.{r} IS NOT NULL THEN {cost(t, 'rule.input_rate')} - {cost(t, f'rule.{r}')} ELSE 0 END" for t, r in parts)
    done = " + ".join(f"CASE WHEN {t} > 0 AND rule.{r} IS NOT NULL THEN {t} ELSE 0 END" for t, r in parts)
    missing = " + ".join(f"CASE WHEN {t} > 0 AND rule.{r} IS NULL THEN {t} ELSE 0 END" for t, r in parts) + f" + cache_write_tokens - {_W5} - {_W1}"
    relevant = "(cached_input_tokens > 0 OR cache_write_tokens > 0)"
    ruled = with_rule(events, rules).withColumns({"_done": F.expr(f"CASE WHEN rule IS NOT NULL THEN {done} ELSE 0 END"), "_missing": F.expr(missing)})
    return ruled.withColumns({
        "cache_pricing": F.expr(f"CASE WHEN NOT {relevant} THEN NULL WHEN rule IS NULL OR _done = 0 THEN 'unavailable' WHEN _missing > 0 THEN 'partial' ELSE 'complete' END"),
        "cache_impact_usd_micros": F.expr(f"CASE WHEN {relevant} AND rule IS NOT NULL AND _done > 0 THEN {saved} END"),
    }).select(*events.columns, "cache_pricing", "cache_impact_usd_micros")


def repriced(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with a model whose value or status the rules change, with the new ones, marked pending."""
    old = events.where("model IS NOT NULL").withColumns({"_value": F.col("estimated_api_value_usd_micros"), "_status": F.col("pricing_status")})
    changed = ~(F.col("estimated_api_value_usd_micros").eqNullSafe(F.col("_value")) & F.col("pricing_status").eqNullSafe(F.col("_status")))
    return priced(old, rules).where(changed).drop("_value", "_status").withColumn("sync_status", F.lit("pending"))
