"""The state of local runtimes as a stream: transitions, staleness by a timer, and since when models are listed.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). The state of a runtime is its last
poll, in a value, and the first sight of each model that it lists, in a map. A healthy poll sets a timer; if no
poll comes in STALE_SECONDS, event time passing by (other runtimes' polls move it) makes the runtime stale. A poll that
comes later in the same batch makes it stale by itself, so results do not depend on how polls fall into batches. Polls
older than the last one of their runtime are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import runtime
from ..operators.runtime import KEYS, RESET, STALE_SECONDS

#: Instants are microseconds inside, so no time zone is involved.
_OUT = "device_id string, provider string, at bigint, state string, model string"
_SECOND = 1_000_000
_STALE = STALE_SECONDS * _SECOND


class Runtime(StatefulProcessor):
    """One runtime: rows (KEYS, at, status, models) to rows of _OUT."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, status string, loaded array<string>, stale boolean")
        self.seen = handle.getMapState("seen", "model string", "since bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.last.get()
        for row in sorted(rows, key=lambda r: r.at):
            if before is None or row.at > before[0]:
                yield from self._poll(key, row, before)
                before = (row.at, row.status, [m["id"] for m in (row.models or []) if m["loaded"]] if row.status == "healthy" else [], False)
        if before is not None:
            self.last.update(before)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if before[1] == "healthy" and not before[3]:
                self.handle.registerTimer((before[0] + _STALE) // 1000 + 1)

    def _poll(self, key: tuple, row: Row, before: tuple | None) -> Iterator[Row]:
        def out(state: str, model: str | None = None, at: int = row.at) -> Row:
            return Row(device_id=key[0], provider=key[1], at=at, state=state, model=model)

        at, status, loaded, stale = before or (None, None, [], False)
        healthy = row.status == "healthy"
        fresh = status == "healthy" and row.at - at < _STALE + _SECOND
        if status == "healthy" and not fresh and not stale:
            yield out("server_stale", at=at + _STALE)
        if healthy and not fresh:
            yield out("server_online")
        if fresh and row.status == "unavailable":
            yield out("server_unavailable")
        listed = {m["id"]: m["loaded"] for m in (row.models or [])} if healthy else {}
        if healthy:
            for model in sorted(m for m, on in listed.items() if on and m not in loaded):
                yield out("model_loaded", model)
            for model in sorted(m for m in loaded if listed.get(m, False) is False):
                yield out("model_unloaded", model)
        if healthy or row.status in RESET:
            known = {k[0] for k in self.seen.keys()}
            for model in known - set(listed):
                self.seen.removeKey((model,))
            for model in sorted(set(listed) - known):
                self.seen.updateValue((model,), (row.at,))
                yield out("model_seen", model)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at, status, loaded, stale = self.last.get()
        if status == "healthy" and not stale:
            self.last.update((at, status, loaded, True))
            yield Row(device_id=key[0], provider=key[1], at=at + _STALE, state="server_stale", model=None)

    def close(self) -> None:
        pass


def states(polls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The stream of changes of runtimes (append mode): what ``operators.runtime.transitions`` gives, ``server_stale`` and ``model_seen``."""
    rows = polls.withWatermark("observed_at", delay).withColumn("at", F.unix_micros("observed_at"))
    changes = rows.groupBy(*KEYS).transformWithState(statefulProcessor=Runtime(), outputStructType=_OUT, outputMode="append", timeMode="eventTime")
    return changes.select(*KEYS, F.timestamp_micros("at").alias("observed_at"), "state", "model")


def batch_states(polls: DataFrame, now: datetime) -> DataFrame:
    """The same of all polls up to now, as one batch."""
    order = F.lead("observed_at").over(Window.partitionBy(*KEYS).orderBy("observed_at"))
    late = polls.withColumn("_next", F.coalesce(order, F.lit(now).cast("timestamp_ntz"))).where((F.col("status") == "healthy") & (F.expr("timestampdiff(SECOND, observed_at, _next)") > STALE_SECONDS))
    none = F.lit(None).cast("string").alias("model")
    stale = late.select(*KEYS, (F.col("observed_at") + F.expr(f"INTERVAL '{STALE_SECONDS}' SECOND")).alias("observed_at"), F.lit("server_stale").alias("state"), none)
    seen = runtime.sightings(polls).select(*KEYS, F.col("first_seen").alias("observed_at"), F.lit("model_seen").alias("state"), "model")
    return runtime.transitions(polls).unionByName(stale).unionByName(seen)
