"""Inventories in four dialects, quota and billing responses."""

import json
from datetime import datetime

from ledgerlake.sources import responses

SCHEMA = "response_id long, provider string, body string, received_at timestamp_ntz"


def _landed(spark, *items):
    return spark.createDataFrame([(i, p, b if isinstance(b, str) else json.dumps(b), datetime(2026, 9, 1)) for i, (p, b) in enumerate(items)], SCHEMA)


def test_inventories(spark):
    instance = lambda n: {"id": "i", "config": {"context_length": n}}
    df = _landed(
        spark,
        ("omlx", {"models": [{"id": "q", "loaded": True, "max_context_window": 9, "last_access": 1712345678, "secret": "x"}, {"id": "q", "loaded": True, "max_context_window": 9}]}),
        ("ollama", {"models": [{"name": "o", "size": 5, "details": {"parameter_size": "8B", "quantization_level": "Q4"}}]}),
        ("lmstudio", {"models": [{"key": "a", "loaded_instances": [instance(8), instance(8)], "size_bytes": 3, "quantization": {"name": "Q8"}}, {"key": "b", "loaded_instances": [instance(8), instance(4)]}, {"key": "c", "loaded_instances": []}]}),
        ("lmstudio_v0", {"data": [{"id": "v", "state": "not-loaded", "loaded_context_length": 2, "quantization": "Q2"}, {"id": "w", "state": "?"}]}),
        ("omlx", {"models": [{"id": None}]}),
        ("omlx", "broken"),
    )
    rows = {(r.response_id, r.model): tuple(r)[3:8] for r in responses.models(df).collect()}
    assert rows == {
        (0, "q"): (True, 9, None, None, None), (1, "o"): (False, None, 5, "8B", "Q4"), (2, "a"): (True, 8, 3, None, "Q8"), (2, "b"): (True, None, None, None, None),
        (2, "c"): (False, None, None, None, None), (3, "v"): (False, 2, None, None, "Q2"), (3, "w"): (None, None, None, None, None),
    }
    running = spark.createDataFrame([(1, "o", 64), (1, "new", 32)], "response_id long, model string, context_length long")
    merged = {r.model: (r.loaded, r.context_length) for r in responses.with_running(responses.models(df).where("response_id = 1"), running).collect()}
    assert merged == {"o": (True, 64), "new": (True, 32)}


def test_quota_windows(spark):
    df = _landed(
        spark,
        ("claude", {"five_hour": {"utilization": 47.25, "resets_at": "2026-07-11T09:30:00Z"}, "seven_day": {"utilization": 101}, "seven_day_opus": {"utilization": 3}, "seven_day_cowork": {"utilization": 3}, "other": {"utilization": 1}}),
        ("claude", {"limits": [{"key": "weekly a!", "kind": "model_weekly", "scope": "quill_x", "utilization": 6.625}, {"model": "sonnet", "utilization": 3}, {"scope": "cowork", "utilization": 3}, {"utilization": "4"}]}),
        ("claude", {"windows": {"w": {"kind": "weekly", "utilization": 1}}}),
    )
    rows = {(r.response_id, r.key): (r.label, r.kind, r.scope, r.utilization_bps) for r in responses.flat_and_dynamic_windows(df).collect()}
    assert rows == {
        (0, "five_hour"): ("5-hour", "rolling", None, 4725), (0, "seven_day_opus"): ("Opus", "model_weekly", "opus", 300), (1, "weekly_a_"): ("Quill X", "model_weekly", "quill_x", 663),
        (1, "weekly_sonnet"): ("Sonnet", "model_weekly", "sonnet", 300), (2, "w"): ("W", "weekly", None, 100),
    }


def test_billing(spark):
    df = _landed(
        spark,
        ("grok", {"config": {"creditUsagePercent": 37.5, "currentPeriod": {"type": "USAGE_PERIOD_TYPE_WEEKLY", "start": "2026-07-13T06:00:00Z", "end": "2026-07-20T06:00:00Z"}, "onDemandCap": {"val": 8200}, "onDemandUsed": {"val": 615}, "productUsage": [{"product": "SEARCH", "usagePercent": 41.27}, {"usagePercent": 1}]}}),
        ("grok", {"config": {"monthlyLimit": {"val": 7300}, "used": {"val": 1460}, "billingPeriodStart": "2026-05-04T00:00:00Z"}}),
    )
    rows = {(r.response_id, r.key): (r.kind, r.utilization_bps, r.resets_at) for r in responses.billing_windows(df).collect()}
    assert rows == {(0, "weekly_pool"): ("weekly", 3750, datetime(2026, 7, 20, 6)), (0, "product_SEARCH"): ("product", 4127, None), (1, "monthly_credits"): ("monthly", 2000, None)}
    extra = responses.extra_usage(df).first()
    assert (extra.enabled, extra.limit, extra.used, extra.utilization_bps) == (True, 8200, 615, 750)
