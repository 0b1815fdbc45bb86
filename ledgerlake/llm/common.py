"""Shared plumbing: tables, the shared work folder, Arrow batches and bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; a longer document forms a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (tests in local mode) a temporary folder is made
    and set as the checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """wanted, or wanted with underscores, so that it clashes with no column (case-insensitive)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about limit text bytes, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        block = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), [x or b"" for x in texts.slice(a, b - a).to_pylist()]


def map_blocks(
    df: DataFrame, schema: str, work: Callable[[Iterator[tuple[pa.RecordBatch, list[bytes]]]], Iterator[pa.RecordBatch]], column: str = "text"
) -> DataFrame:
    """mapInArrow with work fed by text_blocks."""
    # Python workers import this package from where the driver has it, unless they are told otherwise.
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(text_blocks(batches, column))

    return df.mapInArrow(run, schema)


class _Generation(dict):
    def __init__(self, make: Callable, old: dict):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


class PieceCache:
    """Values of text pieces, each made by make(piece) when first asked for.

    Kept in two generations: pieces in use stay, those unused for a whole
    generation go, so at most 2 * limit are held. lookup() ends a generation that
    is full; ask for it anew with each block.
    """

    def __init__(self, make: Callable, limit: int = 250_000):
        self.make, self.limit, self.now = make, limit, _Generation(make, {})

    def lookup(self) -> Callable:
        if len(self.now) > self.limit:
            self.now.old = {}
            self.now = _Generation(self.make, self.now)
        return self.now.__getitem__


def unsigned_crc32(column: F.Column) -> F.Column:
    return F.crc32(column).cast("long")
