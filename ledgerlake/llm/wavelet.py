"""Token-ID output: one wavelet matrix per shard, in a file of its own format.

A file holds the ids of consecutive documents as bit-planes, highest bit first; each
plane orders the ids stably by the bits above it. With counts of ones per block a
file answers, without being decoded, which id stands at a place (access), how often
an id occurs before a place (rank, count), and where its k-th occurrence is (select).

Documents are dealt to range partitions in doc_id order (rows of one doc_id in text
order, null doc_ids first), each task writes files of about ``SHARD_TOKENS`` ids, and
one row per partition carries the offsets across. Null and empty texts hold the end
id alone; an empty table gives no files. Other columns are not read. A document of any
length lies in one file, which then is as long. Files are rows of a Parquet table, so that
any store Spark can reach holds them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_blocks, stored
from .token_ids import spaced_words_of, token_ids_of

SHARD_TOKENS = 2_000_000
MAGIC = b"WMX1"
#: Bits of a block whose ones are counted.
BLOCK = 512


class WaveletMatrix:
    """A sequence of unsigned ids in bit-planes, with rank and select."""

    def __init__(self, length: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.length, self.planes, self.zeros, self.ranks = length, planes, zeros, ranks
        self.bits = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        width = -(-len(ids) // BLOCK) * BLOCK // 8
        planes, zeros, ranks = np.zeros((bits, width), np.uint8), np.zeros(bits, np.int64), np.zeros((bits, width * 8 // BLOCK + 1), np.uint32)
        for level in range(bits):
            bit = (ids & ids.dtype.type(1 << bits - 1 - level)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            np.cumsum(np.bitwise_count(planes[level].view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32), out=ranks[level, 1:])
            zeros[level] = len(ids) - int(ranks[level, -1])
            if level < bits - 1:
                ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, level: int, place: int) -> int:
        """Ones before place."""
        block = place // BLOCK
        tail = self.planes[level, block * BLOCK // 8 : -(-place // 8)]
        count = int(self.ranks[level, block]) + int(np.bitwise_count(tail).sum())
        return count - (int(tail[-1] >> (place % 8)).bit_count() if place % 8 else 0)

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level, place >> 3] >> (place & 7)) & 1

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, place), self._ones(level, place)
            value = value << 1 | bit
            place = int(self.zeros[level]) + ones if bit else place - ones
        return value

    def _narrow(self, value: int, place: int) -> tuple[int, int]:
        """Where value's ids start below the last plane, and the end of those before place."""
        a, b = 0, place
        for level in range(self.bits):
            one_a, one_b = self._ones(level, a), self._ones(level, b)
            z = int(self.zeros[level])
            a, b = (z + one_a, z + one_b) if value >> (self.bits - 1 - level) & 1 else (a - one_a, b - one_b)
        return a, b

    def rank(self, value: int, place: int) -> int:
        """Occurrences of value before place."""
        if value >> self.bits:
            return 0
        a, b = self._narrow(value, place)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.length)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit in a plane."""
        ones = self.ranks[level].astype(np.int64)
        seen = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(seen[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        place = self._narrow(value, 0)[0] + k
        for level in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - level) & 1
            place = self._select_bit(level, bit, place - int(self.zeros[level]) if bit else place)
        return place

    def _select_bits(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """_select_bit of many k, a stretch of blocks at a time."""
        ones = self.ranks[level].astype(np.int64)
        seen = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = np.searchsorted(seen, k, side="right") - 1
        out, plane = np.empty(len(k), np.int64), self.planes[level].reshape(-1, BLOCK // 8)
        for a in range(0, len(k), 4096):
            part = block[a : a + 4096]
            bits = np.unpackbits(plane[part], axis=1, bitorder="little") == bit
            nth = np.cumsum(bits, axis=1, dtype=np.int16)
            out[a : a + 4096] = part * BLOCK + (nth <= (k[a : a + 4096] - seen[part])[:, None]).sum(axis=1)
        return out

    def occurrences(self, value: int) -> np.ndarray:
        """All places of value: its stretch below the last plane, taken up plane by plane by select."""
        places = np.arange(self.count(value), dtype=np.int64)
        if len(places):
            places += self._narrow(value, 0)[0]
            for level in reversed(range(self.bits)):
                bit = value >> (self.bits - 1 - level) & 1
                places = self._select_bits(level, bit, places - int(self.zeros[level]) if bit else places)
        return places

    def decode(self) -> np.ndarray:
        """All ids: planes undone from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        low = np.zeros(self.length, kind)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.length, bitorder="little").astype(bool)
            out, z = np.empty(self.length, kind), int(self.zeros[level])
            out[~bit] = low[:z]
            out[bit] = low[z:] | kind(1 << (self.bits - 1 - level))
            low = out
        return low.astype(np.uint32)


def write_file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """Header, document table (id, whether it has one, count of ids), zeros, block counts, bit-planes."""
    m = WaveletMatrix.build(ids)
    head = struct.pack("<4sIQI", MAGIC, m.bits, m.length, len(sizes))
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.array(sizes, "<i8").tobytes()
    return b"".join([head, table, m.zeros.astype("<i8").tobytes(), m.ranks.astype("<u4").tobytes(), m.planes.tobytes()])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, counts of ids, and the matrix, whose arrays are views of data."""
    magic, bits, length, docs = struct.unpack_from("<4sIQI", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = struct.calcsize("<4sIQI")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    ids, has, sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
    blocks = -(-length // BLOCK)
    zeros, ranks = take("<i8", bits), take("<u4", bits * (blocks + 1)).reshape(bits, -1)
    planes = take("u1", bits * blocks * BLOCK // 8).reshape(bits, -1)
    return [i if h else None for i, h in zip(ids.tolist(), has.tolist())], sizes, WaveletMatrix(length, planes, zeros, ranks)


def write(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The files of docs (doc_id, text), stored: (part, shard, base, tokens, file), base within the part."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(blocks) -> Iterator[pa.RecordBatch]:
        encoder = token_ids_of(vocabulary, spaced_words_of)
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, tokens = [], [], [], 0

        def file() -> pa.RecordBatch:
            data = write_file(doc_ids, sizes, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, base, tokens)] + [pa.array([data], pa.binary())], names=["part", "shard", "base", "tokens", "file"])

        for batch, texts in blocks:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts, end_id)):
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= shard_tokens:
                    yield file()
                    shard, base = shard + 1, base + tokens
                    doc_ids, sizes, held, tokens = [], [], [], 0
        if tokens:
            yield file()

    return stored(map_blocks(ordered, "part long, shard long, base long, tokens long, file binary", work), "wavelet")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; ids are little-endian unsigned 32-bit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, data in zip(*(batch.column(c) for c in ("part", "base", "file"))):
                doc_ids, sizes, matrix = read_file(data.as_buffer())
                ids, ends = matrix.decode().tobytes(), np.cumsum(sizes)
                starts = ends - sizes
                for a in range(0, len(doc_ids), 512):
                    rows = slice(a, a + 512)
                    cut = [ids[4 * x : 4 * y] for x, y in zip(starts[rows].tolist(), ends[rows].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(cut)), pa.array(doc_ids[rows], pa.int64()), pa.array(starts[rows] + base.as_py()), pa.array(cut, pa.binary())], names=["part", "doc_id", "local", "ids"])

    found = files.select("part", "base", "file").mapInArrow(work, "part long, doc_id long, local long, ids binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each range partition
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "ids")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """(part, shard, place) of every occurrence of an id, by select on the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c) for c in ("part", "shard", "file"))):
                places = read_file(data.as_buffer())[2].occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), part.as_py())), pa.array(np.full(len(places), shard.as_py())), pa.array(places)], names=["part", "shard", "place"])

    return files.select("part", "shard", "file").mapInArrow(work, "part long, shard long, place long")
