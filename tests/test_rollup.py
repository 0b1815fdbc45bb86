"""The rollup by deltas equals the rollup of the whole ledger, whatever is merged and wherever a batch is cut off."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import dashboard, merge, rollup
from ledgerlake.sources import buckets
from ledgerlake.streaming import rollups

from .test_operators import AT, event, ledger


def _rows(df):
    return sorted(map(str, df.select(*rollup.KEYS, *rollup.MEASURES).collect()))


def _events(spark, rng, ids):
    kinds = ["measured", "measured", "measured", "activity_only", "estimated"]
    rows = []
    for i in ids:
        value = rng.choice([None, 5, 70])
        rows.append(event(i, native_session_id=f"s{i % 11}", occurred_at=AT + timedelta(minutes=rng.randrange(200)), model=rng.choice(["m", "n", None]), project_name=rng.choice(["p", None]), total_tokens=rng.randrange(1000), output_tokens=rng.randrange(9),
                          measurement_kind=kinds[i % 5], estimated_api_value_usd_micros=value, pricing_status=rng.choice(["available", "partial"]) if value else "unavailable",
                          superseded_by_event_id="x" if i % 17 == 0 else None, updated_at=AT + timedelta(minutes=rng.randrange(50))))
    return ledger(spark, *rows)


def test_random_merges(spark):
    rng = random.Random(4)
    table = _events(spark, rng, range(40))
    kept = rollup.rolled(table)
    for step in (merge.upsert_revisions, merge.apply_remote, merge.insert_absent):
        after = step(table, _events(spark, rng, rng.sample(range(80), 30)))
        kept, table = rollup.added(kept, rollup.delta(table, after)), after
    assert _rows(kept) == _rows(rollup.rolled(table)) and len(_rows(kept)) > 20
    assert rollup.delta(table, table).count() == 0
    assert rollup.added(kept, rollup.delta(table, table.limit(0))).count() == 0


def test_reports_equal_those_of_the_ledger(spark):
    rows = _events(spark, random.Random(5), range(120))
    now, start = AT + timedelta(hours=30), AT + timedelta(minutes=45)
    rolled = rollup.rolled(rows)
    for zone in ("UTC", "Asia/Kolkata", "America/St_Johns"):
        for name in ("today", "7d", "month", "all"):
            wanted = dashboard.headline(rows, now, zone, name)
            assert rollup.headline(rolled, now, zone, name).select(*wanted.columns).collect() == wanted.collect()
    for by in dashboard.GROUPS:
        wanted = dashboard.breakdown(rows, by, start).drop("percentage")
        assert rollup.breakdown(rolled, by, start).collect() == wanted.select("name", "tokens", "events", "value_usd_micros").collect()
    assert rollup.layers(rolled, start).collect() == dashboard.layers(rows, start).collect()
    assert rollup.snapshot(rolled, now, start).count() == 1
    assert rollup.headline(rolled.limit(0), now).first().events == 0


@pytest.mark.parametrize("step", ["delta", "ledger", "commit"])
def test_a_batch_counts_once_wherever_it_is_cut_off(spark, tmp_path, step):
    rng, path, base = random.Random(6), f"{tmp_path}/ledger", f"{tmp_path}/rollup"
    start = _events(spark, rng, range(40))
    buckets.create(start.limit(0).unionByName(ledger(spark, event(999, native_session_id="none"))), path)
    each = rollups.sink(path, merge.upsert_revisions, base, every=2)
    each(start, 0)
    batch = _events(spark, rng, range(20, 60))

    def kill(at):
        if at == step:
            raise RuntimeError("killed")

    before = _rows(rollups.current(spark, base))
    with pytest.raises(RuntimeError):
        rollups.sink(path, merge.upsert_revisions, base, kill)(batch, 1)
    if step != "commit":
        assert _rows(rollups.current(spark, base)) == before
    for number, rows in ((1, batch), (1, batch), (2, batch), (3, _events(spark, rng, range(5)))):
        each(rows, number)
    whole = rollup.rolled(buckets.read(spark, path).where(F.col("native_session_id") != "none"))
    assert _rows(rollups.current(spark, base)) == _rows(whole)
    rollups.compact(spark, base)
    assert _rows(rollups.current(spark, base)) == _rows(whole)
