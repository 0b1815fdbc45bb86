"""Scalar rules of the ledger as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"
MAX_LONG = 2**63 - 1

# The (provider, source) pairs whose counters are known, by how input counts cached tokens.
CACHE_INCLUDED = [("codex", "codex_cli"), ("grok", "grok_build"), ("gemini", "gemini_cli"), ("omlx", "omlx_usage_hourly")]
CACHE_ADDITIVE = [("claude", "claude_code")]
RUNTIME_SOURCES = [("omlx", "omlx_usage_hourly")]
TOOL_SOURCES = [("codex", "codex_cli"), ("claude", "claude_code"), ("gemini", "gemini_cli"), ("grok", "grok_build")]


def canonical() -> Column:
    """Rows that count: measured and not superseded."""
    return (F.col("measurement_kind") == "measured") & F.col("superseded_by_event_id").isNull()


def activity() -> Column:
    return (F.col("measurement_kind") == "activity_only") & F.col("superseded_by_event_id").isNull()


def is_pair(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("provider") == p) & (F.col("source") == s) for p, s in pairs])


def layer() -> Column:
    """Which layer a row was counted in, by its collector."""
    return F.when(is_pair(RUNTIME_SOURCES), "runtime").when(is_pair(TOOL_SOURCES), "tool").otherwise("unknown")


def semantics() -> Column:
    """How a source's input counter treats cached tokens; null where unknown."""
    return F.when(is_pair(CACHE_INCLUDED), "cache_included").when(is_pair(CACHE_ADDITIVE), "cache_additive")


def saturating_add(*columns: Column) -> Column:
    """Sum of non-negative longs that stops at the largest long."""
    return reduce(lambda a, b: F.coalesce(F.try_add(a, b), F.lit(MAX_LONG)), columns)


def hashed(*parts: Column) -> Column:
    """sha256 of the parts joined by the unit separator; null if a part is."""
    joined = [x for p in parts for x in (F.lit(SEPARATOR), p)][1:]
    return F.sha2(F.concat(*joined), 256)


def normalised_tokens() -> dict[str, Column]:
    """Counters made non-negative and consistent; to be used with withColumns."""
    c = {n: F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for n in ("input_tokens", "cached_input_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens", "reasoning_tokens")}
    split = saturating_add(c["cache_write_5m_tokens"], c["cache_write_1h_tokens"])
    write = F.greatest(F.coalesce("cache_write_tokens", F.lit(0)), F.lit(0), split)
    total = F.when(F.coalesce("total_tokens", F.lit(0)) > 0, F.col("total_tokens")).otherwise(saturating_add(c["input_tokens"], c["output_tokens"]))
    return c | {"cache_write_tokens": write, "total_tokens": total}


def project_name(column: Column) -> Column:
    """Last part of a path, cleaned: no control or reserved characters, 96 characters at most; null if nothing is left."""
    label = F.substring(F.regexp_replace(F.trim(column), r"\p{Cntrl}", ""), 1, 128)
    parts = F.filter(F.split(F.replace(label, F.lit("\\"), F.lit("/")), "/"), lambda x: F.trim(x) != "")
    last = F.try_element_at(parts, F.lit(-1))
    clean = F.trim(F.substring(F.regexp_replace(F.trim(last), r'[\p{Cntrl}<>:"|?*]', ""), 1, 96))
    return F.when(clean != "", clean)


def safe_identifier(column: Column) -> Column:
    """The value if it is a plain identifier of at most 160 bytes, else null."""
    fine = (
        (F.octet_length(column) <= 160) & ~column.rlike(r"^[/.~]") & ~column.contains("\\") & ~column.contains(":/")
        & column.rlike(r"^[\p{IsAlphabetic}\p{N}\-_. /+@:]+$") & ~F.exists(F.split(column, "/"), lambda x: x == "..")
    )
    return F.when(fine, column)


def device_label(column: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.trim(column), r"\p{Cntrl}", ""), 1, 80)
    return F.when(clean != "", clean)


def percent_decoded(column: Column) -> Column:
    """URL decoding that leaves plus signs and malformed escapes alone."""
    escaped = F.regexp_replace(F.replace(column, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(escaped), column)


def rfc3339(column: Column) -> Column:
    """Instant of an RFC 3339 text as UTC (no time zone type), else null."""
    full = column.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(full, F.to_utc_timestamp(F.try_to_timestamp(column), F.current_timezone()).cast("timestamp_ntz"))


def basis_points(part: Column, whole: Column) -> Column:
    """Floor of 10000 * part / whole, within 0..10000; 0 where whole is not positive."""
    scaled = F.greatest(part, F.lit(0)).cast("decimal(19,0)") * F.lit(10000).cast("decimal(19,0)")
    return F.when(whole <= 0, F.lit(0)).otherwise(F.least(F.floor(scaled / F.greatest(whole, F.lit(1)).cast("decimal(19,0)")), F.lit(10000)).cast("long"))


def percent_to_bps(column: Column) -> Column:
    """0..100 as basis points, half away from zero; null outside."""
    return F.when((column >= 0) & (column <= 100), F.round(column * 100).cast("int"))


def cost(tokens: str, rate: str) -> str:
    """SQL of floor(tokens * rate / 10**6) in exact integers, null where the rate is."""
    return f"CAST(greatest({tokens}, 0) AS DECIMAL(19,0)) * CAST(greatest({rate}, 0) AS DECIMAL(19,0)) div 1000000"


def fresh_input(kind: Column) -> Column:
    """Input tokens that were not read from or written to a cache."""
    included = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens") - F.col("cache_write_tokens"), F.lit(0))
    return F.when(kind == "cache_included", included).when(kind == "cache_additive", F.col("input_tokens"))


def coverage(complete: Column, part: Column, whole: Column) -> Column:
    """complete if whole > 0 and complete = whole, partial if part > 0, else unavailable."""
    return F.when((whole > 0) & (complete == whole), "complete").when(part > 0, "partial").otherwise("unavailable")


def backoff_seconds(failures: Column, retry_after: Column) -> Column:
    """Wait after so many failures: five minutes doubled each time up to an hour, or what the server asks, a day at most."""
    waited = F.least(F.lit(3600), F.lit(300) * F.pow(F.lit(2), F.least(F.greatest(failures, F.lit(1)) - 1, F.lit(8))))
    return F.least(F.greatest(F.coalesce(retry_after, F.lit(0)), waited), F.lit(86400)).cast("long")
