"""Packing: sum-of-squares online packing of documents into training windows.

Each task packs the documents of its input split. Level h of its level array
counts the open windows that hold h tokens. A document (its last part, where it
is longer than a window) goes to the level whose window, so filled, leaves the
smallest sum of squared level counts; a new window counts as level 0. Ties go
to the fullest window. At the end of the split the windows still open are
joined and cut anew, so at most one window of a split is padded.

No shuffle, no state beyond one split's open windows (each of at most
``capacity`` tokens), and the same split gives the same windows again after a
lost executor.

Null and empty texts hold the end token alone. Repeated rows and rows of a null
doc_id are packed like any other. An empty table gives no rows. Other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_blocks
from .token_ids import TokenIds, words_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """The level array and the open windows of one stream of documents."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)  # open windows by tokens held; 0 and capacity stay 0
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that leaves the smallest sum of squares."""
        n, top = self.levels, self.capacity - size
        change = 2 * (n[size:] - n[: top + 1])
        change[1:] += 2
        change[0] += 1
        change[-1] -= 1  # a window filled up leaves the array
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put piece, of size < capacity tokens, into a window; returns the window if that fills it."""
        h = self.level_for(size)
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.levels[h + size] += 1
        self.open.setdefault(h + size, []).append(window)
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


def _packed(docs: Iterator[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Windows, each a list of (doc_id, start, ids, doc_tokens)."""
    packer = SumOfSquares(capacity)
    step = 4 * capacity
    for doc_id, ids in docs:
        total = len(ids) // 4
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            yield [(doc_id, a // 4, ids[a : a + step], total)]
        if whole < len(ids):
            piece = (doc_id, whole // 4, ids[whole:], total)
            if full := packer.place(piece, total - whole // 4):
                yield full
    window, room = [], step
    for doc_id, start, ids, total in (p for w in packer.rest() for p in w):
        while ids:
            cut, ids = ids[:room], ids[room:]
            window.append((doc_id, start, cut, total))
            start, room = start + len(cut) // 4, room - len(cut)
            if not room:
                yield window
                window, room = [], step
    if window:
        yield window


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents (doc_id, text) in windows of at most capacity tokens.

    ids are the piece's little-endian unsigned 32-bit token ids; start counts the
    document's tokens before the piece, offset the window's.
    """

    def work(blocks) -> Iterator[pa.RecordBatch]:
        encoder = TokenIds(vocabulary, words_of)
        sequence = TaskContext.get().partitionId() << 40

        def encoded():
            for batch, texts in blocks:
                yield from zip(batch.column("doc_id").to_pylist(), encoder.encode(texts, end_id))

        rows, held = [], 0
        for window in _packed(encoded(), capacity):
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
                held += len(ids) + 64
            sequence += 1
            if held > 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return map_blocks(docs.select("doc_id", "text"), SCHEMA, work)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)
