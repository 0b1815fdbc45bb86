"""Sharding: fixed virtual slots and a versioned slot-to-shard map.

A record is hashed to one of ``SLOTS`` slots, for good. Bytes and rows are summed
per slot, and a small map says which shard holds a slot. Rebalancing edits the
map only: it appends a version in which slots move from heavy shards to light
ones, so just the rows of the moved slots travel. Everything runs in DataFrame
functions; the driver sees the map alone, whose size is fixed by ``SLOTS``.

A null text counts no bytes; null doc_ids and repeated rows hash like others
(equal rows share a slot; copies under other ids are spread, so no shard gets a large
group whole). Ties of weight go by slot number. Texts of any length count whole. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, unsigned_crc32

#: Virtual slots; fixed for the life of a data set, whatever its size or shards.
SLOTS = 8192
#: Bytes of a record besides its text.
RECORD_BYTES = 16

Map = dict[int, int]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row; the text is read once, here."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        unsigned_crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(sized: DataFrame) -> DataFrame:
    """Rows and bytes of each slot in use."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> Map:
    """Version 0: slots dealt round."""
    return {s: s % shards for s in range(slots)}


def rebalanced(current: Map, weight: Map, shards: int, tolerance: float = 0.001) -> Map:
    """The map edited until no shard is more than tolerance above the mean, or no move helps.

    Slots leave shards above the mean, largest that fits first, for the lightest
    shard; slots on shards that no longer exist leave first.
    """
    held: list[list[int]] = [[] for _ in range(shards)]
    load, homeless, out = [0] * shards, [], dict(current)
    for slot in sorted(current, key=lambda s: (-weight.get(s, 0), s)):
        if current[slot] < shards:
            held[current[slot]].append(slot)
            load[current[slot]] += weight.get(slot, 0)
        else:
            homeless.append(slot)
    mean = sum(weight.get(s, 0) for s in current) / shards
    limit = mean * (1 + tolerance)
    moving = homeless
    for shard in range(shards):
        if load[shard] <= limit:
            continue
        for slot in list(held[shard]):
            w = weight.get(slot, 0)
            if w and load[shard] - w >= mean * (1 - tolerance):
                load[shard] -= w
                held[shard].remove(slot)
                moving.append(slot)
            if load[shard] <= limit:
                break
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-weight.get(s, 0), s)):
        now, shard = heapq.heappop(heap)
        out[slot] = shard
        held[shard].append(slot)
        heapq.heappush(heap, (now + weight.get(slot, 0), shard))
    load = [sum(weight.get(s, 0) for s in h) for h in held]
    return _swapped(out, held, load, weight, mean, tolerance)


def _swapped(out: Map, held: list[list[int]], load: list[int], weight: Map, mean: float, tolerance: float) -> Map:
    """Last edits: move or swap single slots between the heaviest and the lightest shard."""
    for _ in range(20 * len(load)):
        hi, lo = max(range(len(load)), key=lambda s: (load[s], -s)), min(range(len(load)), key=lambda s: (load[s], s))
        gap = load[hi] - load[lo]
        if gap <= 2 * tolerance * mean:
            break
        give = [(weight.get(s, 0), s) for s in held[hi]]
        take = [(0, -1), *((weight.get(s, 0), s) for s in held[lo])]
        best = min(((abs(gap - 2 * (a - b)), a - b, s, t) for a, s in give for b, t in take if 0 < a - b < gap), default=None)
        if best is None:
            break
        _, d, s, t = best
        held[hi].remove(s)
        held[lo].append(s)
        out[s] = lo
        if t >= 0:
            held[lo].remove(t)
            held[hi].append(t)
            out[t] = hi
        load[hi] -= d
        load[lo] += d
    return out


def map_table(spark: SparkSession, versions: list[Map], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """The stored map: (version, vslot, shard, first), first being the rows of lower slots on that shard.

    Written to the shared folder; versions are only ever added.
    """
    rows = []
    for v, m in enumerate(versions):
        first: dict[int, int] = {}
        for slot in sorted(m):
            rows.append((v, slot, m[slot], first.get(m[slot], 0)))
            first[m[slot]] = first.get(m[slot], 0) + sizes.get(slot, (0, 0))[1]
    schema = "version int, vslot int, shard int, first long"
    return stored(spark.createDataFrame(rows, schema).coalesce(1), "slot-map")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Each row of docs (doc_id, text) with its shard and its place there, shards near equal in bytes.

    slot is the row's place in its shard, gapless from 0 in the order of
    (virtual slot, doc_id); law says which law holds.
    """
    spark = docs.sparkSession
    sized = stored(records(docs, slots), "records")
    sizes = {r.vslot: (r.bytes, r.rows) for r in slot_sizes(sized).collect()}  # at most ``slots`` rows
    start = first_map(slots, shards)
    edited = rebalanced(start, {s: b for s, (b, _) in sizes.items()}, shards)
    current = map_table(spark, [start, edited], sizes).where("version = 1")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        sized.withColumn("place", place)
        .join(F.broadcast(current), "vslot")  # the map has ``slots`` rows, whatever the data
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
        )
    )
