"""The stream of session logs: splits, changes, restarts and crashes."""

import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import merge
from ledgerlake.sources import buckets, logs, logstream
from ledgerlake.streaming import scan

NOW = datetime(2026, 9, 6, 12)


def _log(session, n):
    lines = [{"type": "session_meta", "payload": {"id": session, "cwd": "/w/p"}}, {"type": "turn_context", "payload": {"turn_id": "t", "model": f"m{n}"}}]
    for i in range(n):
        usage = {"input_tokens": 10 + i, "output_tokens": 1}
        lines.append({"timestamp": "2026-09-01T10:00:00Z", "ordinal": i, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage}}})
    return "".join(json.dumps(x) + "\n" for x in lines) + "{broken\n\n"


def test_splits_hold_each_line_once(tmp_path):
    rng = random.Random(1)
    for content in ("", "a", "\n", "\n\n", "ab\ncd", "ab\ncd\n", "é\n" * 9 + "tail", "\n".join("x" * rng.randrange(9) for _ in range(50))):
        path = tmp_path / "x.jsonl"
        path.write_text(content)
        size = len(content.encode())
        for step in (1, 2, 3, 7, 100):
            found = [x for at in range(0, size, step) for x in logstream._lines(logstream.Split(str(path), size, 0, at, min(at + step, size)))]
            wanted = content.encode().split(b"\n")
            assert found == (wanted[:-1] if wanted[-1] == b"" else wanted), (content, step)
    path.write_text("first\nsecond\nthird")
    assert list(logstream._lines(logstream.Split(str(path), 9, 0, 0, 9))) == [b"first", b"sec"]  # not beyond the listed size


def test_listings_and_offsets(tmp_path):
    root = tmp_path / "logs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "X.JSONL").write_text("1\n2\n")
    (root / "a" / "x.txt").write_text("1\n")
    reader = logstream._Reader({"roots": json.dumps([str(root), str(tmp_path / "none")]), "listings": str(tmp_path / "listings"), "splitBytes": "2"})
    assert reader.latestOffset() == reader.latestOffset() == {"listing": 1}
    assert [(p.start, p.stop) for p in reader.partitions({"listing": 0}, {"listing": 1})] == [(0, 2), (2, 4)]
    assert reader.partitions({"listing": 1}, {"listing": 1}) == []
    (root / "b.jsonl").write_text("3\n")
    assert reader.latestOffset() == {"listing": 2}
    assert [os.path.basename(p.name) for p in reader.partitions({"listing": 1}, {"listing": 2})] == ["b.jsonl"]
    newer = logstream._Reader({"roots": json.dumps([str(root)]), "listings": str(tmp_path / "listings"), "parser": "2"})
    assert len(newer.partitions({"listing": 2}, newer.latestOffset())) == 2  # another parser: all files again


def _ledger_rows(rows):
    day = F.lit(NOW).cast("timestamp_ntz")
    return rows.select("id", "provider", "native_session_id", "native_event_id", "occurred_at", "model", "total_tokens", day.alias("updated_at"))


@pytest.fixture
def stream(spark, tmp_path):
    root, base, path = tmp_path / "logs", f"{tmp_path}/scan", f"{tmp_path}/ledger"
    root.mkdir()
    kinds = "id string, provider string, native_session_id string, native_event_id string, occurred_at timestamp_ntz, model string, total_tokens long, updated_at timestamp_ntz"
    buckets.create(spark.createDataFrame([("0", "codex", "none", "e", NOW, "m", 1, NOW)], kinds), path)

    def run(after=lambda step: None):
        read = scan.lines(spark, json.dumps([str(root)]), f"{tmp_path}/listings", split_bytes=300)
        each = scan.sink(logs.codex, "codex", 1, base, lambda: NOW, (path, merge.insert_absent, _ledger_rows), after)
        read.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    return root, base, path, run


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def _wanted(spark, root):
    files = [(str(p), p.read_text()) for p in sorted(root.rglob("*.jsonl"))]
    return _ids(logs.codex(spark.createDataFrame(files, "path string, content string"))[0])


def test_new_and_changed_files(spark, stream):
    root, base, path, run = stream
    for i in range(3):
        (root / f"{i}.jsonl").write_text(_log(f"s{i}", 5 + i))
    run()
    assert _ids(scan.committed(spark, base, "rows")) == _wanted(spark, root) == _ids(buckets.read(spark, path).where("id <> '0'"))
    run()  # nothing new
    assert scan.committed(spark, base, "rows").select("batch").distinct().count() == 1
    (root / "1.jsonl").write_text(_log("s1", 9))
    (root / "3.jsonl").write_text(_log("s3", 2))
    run()
    again = scan.committed(spark, base, "rows").where("batch = 1")
    assert {r.native_session_id for r in again.select("native_session_id").distinct().collect()} == {"s1", "s3"}
    assert _ids(scan.current_rows(spark, base)) == _wanted(spark, root) == _ids(buckets.read(spark, path).where("id <> '0'"))
    entries = {r.path[-7:]: r for r in scan.manifest(spark, base).collect()}
    assert len(entries) == 4 and all(r.status == "warning" and r.diagnostic == "malformed_json" for r in entries.values())
    assert entries["1.jsonl"].file_size == (root / "1.jsonl").stat().st_size
    tallies = {(r.batch, r.path[-7:]): (r.seen, r.used, r.diagnosed, r.ignored) for r in scan.committed(spark, base, "tallies").collect()}
    assert tallies[(0, "0.jsonl")] == (9, 5, 1, 1) and tallies[(1, "1.jsonl")] == (13, 9, 1, 1)


@pytest.mark.parametrize("step", ["rows", "manifest", "ledger", "commit"])
def test_killed_after_a_step_and_restarted(spark, stream, step):
    root, base, path, run = stream
    (root / "0.jsonl").write_text(_log("s0", 4))
    run()
    (root / "1.jsonl").write_text(_log("s1", 6))

    def kill(at):
        if at == step:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(kill)
    seen = _ids(scan.committed(spark, base, "rows"))
    assert len(seen) == (10 if step == "commit" else 4)
    run()
    assert _ids(scan.committed(spark, base, "rows")) == _wanted(spark, root) == _ids(buckets.read(spark, path).where("id <> '0'"))
    assert scan.manifest(spark, base).count() == 2
