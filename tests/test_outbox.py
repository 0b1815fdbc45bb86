"""Pushes and pulls that are cut off neither skip nor repeat; pages by cursor equal the whole order."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import keyset, merge
from ledgerlake.sources import buckets
from ledgerlake.streaming import outbox

from .test_operators import AT, event, ledger


def _killer(step):
    def kill(at):
        if at == step:
            raise RuntimeError("killed")

    return kill


@pytest.mark.parametrize("step", ["begun", "sent", "marked", "ended"])
def test_each_row_is_delivered_once(spark, tmp_path, step):
    path, base, received = f"{tmp_path}/ledger", f"{tmp_path}/outbox", {}
    rows = [event(i, account_id=f"a{i % 2}", native_session_id=f"s{i % 5}", sync_status="pending" if i % 3 else "synced", created_at=AT + timedelta(minutes=i % 7)) for i in range(40)]
    buckets.create(ledger(spark, *rows, event(99, account_id="a0", sync_status="error")), path)
    read = lambda: buckets.read(spark, path).drop(buckets.BUCKET)

    def send(rows):
        for r in rows.collect():
            received.setdefault((r.account_id, r.number, r.batch), set()).add(r.id)

    mark = lambda rows: buckets.merge_into(spark, path, rows.drop("number", "batch"), merge.acknowledged)
    push = lambda after=lambda s: None: outbox.push(spark, base, "events", read, send, mark, 3, after)
    waiting = {(r.account_id, r.id) for r in read().where("sync_status <> 'synced'").collect()}
    with pytest.raises(RuntimeError):
        push(_killer(step))
    late = ledger(spark, event(77, account_id="a1", sync_status="pending"))  # comes between the runs
    buckets.merge_into(spark, path, late, merge.insert_absent)
    push()
    push()
    assert push() == 0
    sent = Counter((account, i) for (account, _, _), ids in received.items() for i in ids)
    assert set(sent) == waiting | {("a1", event(77)["id"])} and set(sent.values()) == {1}
    assert read().where("sync_status <> 'synced'").count() == 0 and max(map(len, received.values())) <= 3
    assert outbox.report(spark, base).select("rows").first()[0] == len(waiting) + 1


@pytest.mark.parametrize("step", ["begun", "applied", "ended"])
def test_pulls_meet_without_gaps(spark, tmp_path, step):
    base, taken, clock = f"{tmp_path}/outbox", [], [AT]
    remote = [event(i, updated_at=AT + timedelta(minutes=i - 5)) for i in range(20)]

    def pull(minutes, after=lambda s: None):
        clock[0] = AT + timedelta(minutes=minutes)
        return outbox.pull(spark, base, "events", lambda: ledger(spark, *remote), lambda rows: taken.append({r.id for r in rows.collect()}), lambda: clock[0], after)

    assert pull(0) == 6
    with pytest.raises(RuntimeError):
        pull(3, _killer(step))
    pull(8)
    assert pull(30) + pull(40) >= 6
    assert set().union(*taken) == {e["id"] for e in remote}
    finished = outbox.log(spark, base).where("way = 'pull'").orderBy("number").collect()
    assert sum(r.rows for r in finished) == 20 and [r.number for r in finished] == list(range(1, len(finished) + 1))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_pages_are_the_whole_order(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), i) for i in range(25)]
    table = spark.createDataFrame(rows, "x int, y string, id int")
    for order in ((keyset.By("x", True), keyset.By("y"), keyset.By("id")), (keyset.By("x"), keyset.By("y", True), keyset.By("id", True))):
        wanted = [r.id for r in table.orderBy(*(by.sort() for by in order)).collect()]
        found, cursor = [], None
        while part := keyset.page(table, order, size, cursor).collect():
            found += [r.id for r in part]
            cursor = keyset.cursor_of(part[-1], order)
        assert found == wanted
    assert keyset.end_of(keyset.page(table, order, size), order) == keyset.cursor_of(keyset.page(table, order, size).collect()[-1], order)
    assert keyset.end_of(table.limit(0), order) is None


def test_pages_prune_days(spark, tmp_path):
    rows = ledger(spark, *(event(i, occurred_at=AT - timedelta(hours=5 * i)) for i in range(40))).withColumn("day", F.col("occurred_at").cast("date"))
    rows.write.partitionBy("day").parquet(f"{tmp_path}/ledger")
    table = spark.read.parquet(f"{tmp_path}/ledger")
    cursor = (AT - timedelta(hours=100), event(20)["id"])
    found = keyset.page(table, keyset.ACTIVITY, 5, cursor, day="day")
    assert [int(r.id) for r in found.collect()] == [21, 22, 23, 24, 25]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((day" in plan or "PartitionFilters: [(day" in plan
    assert "PushedFilters: [Or(" in plan or "LessThan(occurred_at" in plan
