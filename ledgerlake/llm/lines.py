"""Line dedup: levelled sorted runs of line hashes, merged as batches arrive.

A run is a sorted table of (line hash, documents that have it). Each new batch of
documents is pre-aggregated, anti-joined with the lines that the merged runs have
already settled as frequent, and added as a run of level 0; ``fanout`` runs of a
level are compacted into one of the next. Lines in at least ``min_docs`` documents
lose every occurrence. Hashes are 128 bits. No line is collected: counts, hits and
texts meet in joins, whose hot keys adaptive execution splits, and the rows of a
batch are summed before they are shuffled.

A row is a document: repeated rows count as often as they occur. Null and empty
texts are one empty line, which is never dropped (min_chars is 1). Null doc_ids
are treated like any id. Other columns pass through; added columns get underscores
where names clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_blocks, stored

#: Batches in which a table arrives, and runs of a level that are compacted into one.
BATCHES, FANOUT = 4, 2
_lower = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def line_hash(line: bytes, min_chars: int = 1) -> bytes | None:
    """128 bits of the line's key, or None for a key of under min_chars code points."""
    key = line.strip(b" \t\n\x0b\x0c\r").translate(_lower)
    if not key or min_chars > 1 and len(key.decode()) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


class LineRuns:
    """Runs by level; ``add`` merges a batch's counts in, ``frequent`` reads them."""

    def __init__(self, min_docs: int, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def settled(self) -> DataFrame | None:
        """Lines that the compacted runs alone show to be frequent."""
        runs = [r for level in self.levels[1:] for r in level]
        return reduce(DataFrame.unionByName, [r.where(F.col("docs") >= self.min_docs).select("line") for r in runs]) if runs else None

    def add(self, counts: DataFrame) -> None:
        known = self.settled()
        if known is not None:
            counts = counts.join(known, "line", "left_anti")
        self._push(0, counts)

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stored(run.sortWithinPartitions("line"), f"lines-level{level}"))
        if len(self.levels[level]) == self.fanout:
            merged = _summed(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    def frequent(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return _summed(reduce(DataFrame.unionByName, runs)).where(F.col("docs") >= self.min_docs).select("line")


def _summed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("line").agg(F.sum("docs").alias("docs"))


def drop_frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """docs with frequent lines gone from text, and n_lines (before) and n_dropped."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def hashes(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            ids, ths, rows, lines = batch.column("doc_id"), batch.column("th"), [], []
            for i, text in enumerate(texts):
                found = {line_hash(x, min_chars) for x in set(text.split(b"\n"))} - {None}
                rows += [i] * len(found)
                lines += found
            rows = pa.array(rows, pa.int64())
            parts = pa.array([t % batches for t in ths.take(rows).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), ths.take(rows), pa.array(lines, pa.binary()), parts], names=["doc_id", "th", "line", "batch"])

    lines = stored(map_blocks(keyed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, line binary, batch long", hashes), "line-hashes")
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).groupBy("line").agg(F.count(F.lit(1)).alias("docs")))
    frequent = stored(runs.frequent(), "lines-frequent")
    hits = lines.join(frequent, "line").groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines"))
    return _without(docs, hits, min_chars)


def _without(docs: DataFrame, hits: DataFrame, min_chars: int) -> DataFrame:
    columns = docs.columns
    n_lines, n_dropped, th, drop, doc, hash_ = (free_name(columns, x) for x in ("n_lines", "n_dropped", "text_hash", "drop_lines", "hit_doc", "hit_hash"))
    hits = hits.select(F.col("doc_id").alias(doc), F.col("th").alias(hash_), F.col("lines").alias(drop))
    joined = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = joined.join(hits, joined["doc_id"].eqNullSafe(F.col(doc)) & (F.col(th) == F.col(hash_)), "left").select(*columns, drop)

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            kept, before, gone = [], [], []
            for text, lines in zip(texts, batch.column(drop).to_pylist()):
                parts = text.split(b"\n")
                stay = parts
                if lines:
                    lines = set(lines)
                    stay = [x for x in parts if line_hash(x, min_chars) not in lines]
                kept.append(b"\n".join(stay))
                before.append(len(parts))
                gone.append(len(parts) - len(stay))
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in columns), pa.array(before), pa.array(gone)], names=[*columns, n_lines, n_dropped])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_blocks(joined, ", ".join([*kinds, f"`{n_lines}` bigint", f"`{n_dropped}` bigint"]), work)
