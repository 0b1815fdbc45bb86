"""Conversation repair: the cheapest edits after which roles alternate, by branch and bound.

A conversation is a row of turns, each with an initial (of its role) and at most one fault:
blank, duplicate of an earlier turn, or truncated. Edits keep, rerole, delete or insert
turns so that the roles read ``(s?(ua)+)?``. A search node is (turn, state of that
pattern). The search goes depth first over an explicit stack, edits in ASCII order of
their initials, and drops a prefix if its cost plus the suffix bound of its node does not go below the
incumbent, or if its node was reached at no greater cost before (dominance). The suffix
bound is the least cost of the rest from that node, whatever its audit, made
backwards; so each node is expanded once or twice, however long the conversation. As
prefixes arrive in ASCII order, a later one of equal cost is never the least.

Turns meet by conversation in one sorted shuffle; a task keeps a byte for each turn of
one conversation, the audit and up to ``HELD`` characters of text. Longer conversations get
their hash in a second, streaming pass over their turns, which read the audit first.

Null roles and texts are one space, a null turn is one in the damage and goes first. Turns
of equal number go by role and text. Null conv_ids form one conversation. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, unsigned_crc32

#: Costs of edits and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Characters of text of one conversation that a task holds until its audit is known; beyond, a second pass hashes.
HELD = 1 << 22
#: States: nothing yet, after s, after u, after a; the state after the next user or assistant, and after a kept initial.
ACCEPTED = (0, 3)
ALTERNATE = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
_INFINITE = 1 << 60


def _steps(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn with their cost and the state after them, in ASCII order."""
    yield "D", DELETE, state
    if fault in ("", "truncated"):
        more = TRUNCATED if fault else 0
        if initial in KEPT[state]:
            yield "K", more, KEPT[state][initial]
        yield "R", REROLE + more, ALTERNATE[state]


def suffix_bounds(turns: list[tuple[str, str]]) -> list[list[int]]:
    """For each node the least cost of all that follows."""
    bounds = [[_INFINITE] * 4 for _ in range(len(turns) + 1)]
    for i in range(len(turns), -1, -1):
        row = bounds[i]
        for q in range(4):
            if i == len(turns):
                row[q] = 0 if q in ACCEPTED else _INFINITE
            else:
                row[q] = min(cost + bounds[i + 1][to] for _, cost, to in _steps(*turns[i], q))
        for _ in range(3):  # inserts lead from state to state of the same turn
            for q in range(4):
                row[q] = min(row[q], INSERT + row[ALTERNATE[q]])
    return bounds


def search(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns (initial, fault), the ASCII-least of equal ones."""
    bounds, n = suffix_bounds(turns), len(turns)
    best = [[_INFINITE] * 4 for _ in range(n + 1)]  # per node the least cost of a prefix so far
    incumbent, found = bounds[0][0] + 1, ""  # bounds are attained, so nothing dearer than the root's is worth a visit
    stack: list[tuple[int, int, int, tuple | None]] = [(0, 0, 0, None)]
    while stack:
        i, q, cost, edits = stack.pop()
        if cost + bounds[i][q] >= incumbent or cost >= best[i][q]:
            continue
        best[i][q] = cost
        if i == n and q in ACCEPTED:
            incumbent, found = cost, _spelled(edits)
        steps = [(edit, more, to, i + 1) for edit, more, to in (_steps(*turns[i], q) if i < n else ())]
        steps.append(("I", INSERT, ALTERNATE[q], i))
        for edit, more, to, after in sorted(steps, reverse=True):
            stack.append((after, to, cost + more, (edit, edits)))
    return incumbent, found


def _spelled(edits: tuple | None) -> str:
    out = []
    while edits is not None:
        out.append(edits[0])
        edits = edits[1]
    return "".join(reversed(out))


#: Conversations of the same initials and faults have the same repair; longer ones are rare and searched each time.
_known = lru_cache(1 << 16)(lambda codes: search([_turn(c) for c in codes]))
#: A byte for each turn: its initial (s, u, a or another) and fault.
INITIALS = "sua"


def _code(initial: str, fault: int) -> int:
    return (INITIALS.index(initial) if initial and initial in INITIALS else 3) * 4 + fault


def _turn(code: int) -> tuple[str, str]:
    return (INITIALS + "?")[code // 4], FAULTS[code % 4]


def solved(codes: bytes) -> tuple[int, str]:
    return _known(codes) if len(codes) <= 64 else search([_turn(c) for c in codes])


class Repaired:
    """SHA-256 of the repaired conversation, fed turn by turn along an audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.hash = audit, 0, 0, True, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = ALTERNATE[self.state]
            self._put(ROLE[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[self.state][role[0]]
            self._put(role, text)
        elif edit == "R":
            self.state = ALTERNATE[self.state]
            self._put(ROLE[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with the damage that their ids deal: dropped, emptied, cut, repeated or with another role; ``copy`` numbers repeats."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = unsigned_crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_kind")
    return rows.withColumn("copy", F.explode(F.expr("if(_kind = 3, array(0, 1), array(0))"))).drop("_kind")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def faulty(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copy) with ``fault``, the place of their first fault in FAULTS, sorted within conversations that lie whole in a partition."""
    one = turns.repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*_order())) > 1
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", 1).when(F.col("_earlier"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return one.withColumn("_earlier", earlier).withColumn("fault", fault.cast("int")).drop("_earlier").sortWithinPartitions("conv_id", *_order())


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Conversation:
    """What a task keeps of the conversation that it reads."""

    def __init__(self, conv_id, held: int):
        self.conv_id, self.held = conv_id, held
        self.codes, self.faults, self.illegal = bytearray(), [0] * 4, 0
        self.least = self.most = self.before = self.initial = None
        self.distinct, self.texts = 0, []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.codes:
            self.illegal += f"{self.initial}{initial}" not in ("su", "ua", "au")
        self.codes.append(_code(initial, fault))
        self.faults[fault] += 1
        self.initial = initial
        if turn is not None:
            self.least, self.most = turn if self.least is None else self.least, turn
            self.distinct += turn != self.before
            self.before = turn
        if self.texts is not None:
            self.texts.append((role, text))
            self.held -= len(text)
            if self.held < 0:
                self.texts = None

    def row(self) -> tuple:
        cost, audit = solved(bytes(self.codes))
        digest = None
        if self.texts is not None:
            out = Repaired(audit)
            for role, text in self.texts:
                out.turn(role, text)
            digest = out.digest()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit, digest


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the batches, column by column."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def repaired(turns: DataFrame, held: int = HELD) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text, copy): its faults, and the cheapest repair."""
    rows = faulty(turns)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in _NAMES[1:7])}, audit string, repaired_sha256 string"

    def work(batches) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for conv_id, turn, role, text, fault in _runs(batches, "conv_id", "turn", "role", "text", "fault"):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv_id, held)
            now.add(turn, role, text, fault)
            if len(out) >= 4096:
                yield _batch(out, _NAMES)
                out = []
        if now is not None:
            yield _batch([*out, now.row()], _NAMES)

    first = stored(rows.mapInArrow(work, schema), "repairs")
    if not first.where("repaired_sha256 IS NULL").take(1):
        return first
    digests = _streamed(rows, first.where("repaired_sha256 IS NULL").select("conv_id", "audit"), kind)
    joined = first.join(digests, first["conv_id"].eqNullSafe(digests["of"]), "left")
    return joined.select(*(first[n] for n in _NAMES[:-1]), F.coalesce("repaired_sha256", "digest").alias("repaired_sha256"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if n in ("audit", "repaired_sha256", "digest") else pa.int64()) for i, n in enumerate(names)], names=names)


def _streamed(rows: DataFrame, audits: DataFrame, kind: str) -> DataFrame:
    """(of, digest) of the conversations of audits: each task reads an audit and then its turns, and holds no text."""
    wanted = audits.select(F.col("conv_id").alias("_of"), F.lit(1).alias("_there"))
    some = rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("_of")), "left_semi").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copy")
    heads = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"))
    both = heads.unionByName(some).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_order())

    def work(batches) -> Iterator[pa.RecordBatch]:
        now, conv = None, None
        for conv_id, part, role, text in _runs(batches, "conv_id", "part", "role", "text"):
            if not part:
                if now is not None:
                    yield _batch([(conv, now.digest())], ["of", "digest"])
                conv, now = conv_id, Repaired(text)
            else:
                now.turn(role, text)
        if now is not None:
            yield _batch([(conv, now.digest())], ["of", "digest"])

    return both.mapInArrow(work, f"of {kind}, digest string")


def with_all(repairs: DataFrame, turns: DataFrame) -> DataFrame:
    """repairs with the conversations of which no turn is left."""
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(repairs, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {**{n: F.lit(0) for n in _NAMES[1:7]}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select(F.col("_id").alias("conv_id"), *(F.coalesce(n, v).alias(n) for n, v in nothing.items()))
