"""A trie of conversation prefixes, screened by a count-min sketch of their digests.

A prefix is the sequence of the first turns (role and text) of a conversation. Its digest
is a pair of polynomials modulo 2**64 over 128-bit hashes of the turns, so it is
summed along the turns: conversations are sorted by ranges, each range sums its own turns,
and what a conversation brings into a range from earlier ones (one row for each range) is
added afterwards. No conversation has to fit in a task.

The sketch (``ROWS`` rows of counters that stop at two, two bits each) counts all digests. A
digest with a count of one in some row occurs once: its node has one member, and is written
by the task that reads it. Only other prefixes are shuffled and grouped exactly. Sums over
subtrees need no walk of the trie: along a conversation, the nodes of which it is the
smallest member are the deepest ones, so what it adds to a node is the words between that node
and the first of those, and its leaf counts at all its prefixes.

The sketch has about four counters for each prefix in each row up to ``WIDEST`` (25 MB in all,
held by the driver and every task). Past some 10**8 prefixes it fills up; then more prefixes are
grouped exactly, with the same result.

Turns go by number (nulls first), then role and digest. Null roles and texts are empty. Rows
without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unsigned_crc32
from .words import mixed

#: Odd bases of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows of the sketch, least and greatest counters of a row, pieces in which tasks hand it over.
ROWS, NARROWEST, WIDEST, SLICES = 3, 1 << 12, 1 << 25, 64
#: Families of conversations that ``rebuilt`` gives common first turns, and how many at most.
FAMILY, SHARED = 20, 3
WORD = r"[^\x20\x09-\x0D]+"


def _u(column: pa.Array) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _columns(batch: pa.RecordBatch, **new: np.ndarray) -> pa.RecordBatch:
    """batch with some columns replaced or added."""
    arrays = dict(zip(batch.schema.names, batch.columns)) | {n: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for n, x in new.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


_TURN = "k long, a long, b long, a0 long, b0 long, words long, w0 long"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, a, b, a0, b0, words, w0) of each turn: its number from 1, the digest after and before it, its words and those before it."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.md5(key)).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", "turn", "role", "h"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "h", "words")

    def local(batches) -> Iterator[pa.RecordBatch]:
        conv, k, w, state, power = None, 0, 0, [np.uint64(0)] * 2, [np.uint64(1)] * 2
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, words = np.asarray(batch.column("conv_id")), np.asarray(batch.column("words"))
            hashes = np.frombuffer(b"".join(batch.column("h").to_pylist()), np.uint64).reshape(-1, 2)
            heads = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
            place = np.arange(n) - heads[run]
            goes_on = (run == 0) & (ids[0] == conv)
            out = {"k": place + 1 + np.where(goes_on, k, 0)}
            sums = np.cumsum(words) - words
            out["w0"] = sums - sums[heads][run] + np.where(goes_on, w, 0)
            last = int(heads[-1])
            for i, name in enumerate("ab"):
                powers = _powers(BASES[i], n)
                terms = hashes[:, i] * powers[place + 1]
                before = np.cumsum(terms) - terms
                before = before - before[heads][run]
                scale, start = np.where(goes_on, power[i], np.uint64(1)), np.where(goes_on, state[i], np.uint64(0))
                out[f"{name}0"] = start + scale * before
                out[name] = out[f"{name}0"] + scale * terms
                state[i] = out[name][-1]
                power[i] = scale[-1] * powers[n - last]
            conv, k, w = ids[-1], int(out["k"][-1]), int(out["w0"][-1] + words[-1])
            yield _columns(batch.select(["part", "conv_id", "words"]), **out).select(["part", "conv_id", "k", "a", "b", "a0", "b0", "words", "w0"])

    summed = stored(ranged.mapInArrow(local, f"part int, conv_id long, {_TURN}"), "turns")
    carried = _carried(summed)

    def whole(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids = np.asarray(batch.column("part")), np.asarray(batch.column("conv_id"))
            new = {n: np.array(np.asarray(batch.column(n)), copy=True) for n in ("k", "w0", "a", "b", "a0", "b0")}
            for part in np.unique(parts).tolist():
                if part not in carried:
                    continue
                conv, k, a, b, w = carried[part]
                rows = np.flatnonzero((parts == part) & (ids == conv))
                new["k"][rows] += k
                new["w0"][rows] += w
                for i, (name, start) in enumerate((("a", a), ("b", b))):
                    scale = np.uint64(pow(BASES[i], k, 1 << 64))
                    for n in (name, f"{name}0"):
                        x = new[n].view(np.uint64)
                        x[rows] = np.uint64(start) + scale * x[rows]
            yield _columns(batch, **new).drop_columns(["part"])

    return summed.mapInArrow(whole, f"conv_id long, {_TURN}")


def _carried(summed: DataFrame) -> dict[int, tuple[int, int, int, int, int]]:
    """What the first conversation of a range brings from earlier ranges: (conv_id, turns, a, b, words). One row a range is collected."""
    last = F.max(F.struct("conv_id", "k", "a", "b", (F.col("w0") + F.col("words")).alias("w"))).alias("last")
    found, conv, state = {}, None, (0, 0, 0, 0)
    for r in sorted(summed.groupBy("part").agg(F.min("conv_id").alias("first"), last).collect()):
        k, a, b, w = r.last.k, r.last.a % (1 << 64), r.last.b % (1 << 64), r.last.w
        if r.first == conv:
            found[r.part] = (conv, *state)
            if r.last.conv_id == conv:
                k, w = state[0] + k, state[3] + w
                a, b = ((s + pow(base, state[0], 1 << 64) * x) % (1 << 64) for base, s, x in zip(BASES, state[1:3], (a, b)))
        conv, state = r.last.conv_id, (k, a, b, w)
    return found


#: What ``trie`` reads: a row for each prefix of each conversation, from depth 0, where (a, b) is the digest, (a0, b0) that of its parent and size the turns of the conversation.
_PATH = ["conv_id", "depth", "a", "b", "a0", "b0", "words", "w0", "size"]


def paths(turns: DataFrame) -> DataFrame:
    """The prefixes of turns (conv_id, turn, role, text) as they are."""
    own = stored(numbered(turns), "numbered")
    sizes = own.groupBy("conv_id").agg(F.max("k").alias("size"))
    return _roots(sizes).unionByName(own.withColumnRenamed("k", "depth").join(sizes, "conv_id").select(*_PATH))


def _roots(sizes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sizes.select("conv_id", *(zero.alias(c) for c in _PATH[1:-1]), F.col("size").cast("long").alias("size"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The prefixes of conversations that begin like the first of their family: crc32 of the conv_id says how many turns are taken from there."""
    own = stored(numbered(turns), "numbered")
    turn = F.struct("k", "a", "b", "a0", "b0", "words", "w0")
    convs = own.groupBy("conv_id").agg(F.max("k").alias("turns"), F.array_sort(F.collect_list(F.when(F.col("k") <= SHARED, turn))).alias("head"))  # SHARED turns at most
    convs = stored(convs.withColumn("h", (unsigned_crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    taken = F.coalesce(F.slice("base_head", 1, F.col("h")), F.slice("head", 1, 0))
    joined = convs.join(base, F.expr(f"conv_id - conv_id % {FAMILY}") == F.col("base"), "left").withColumn("taken", taken)
    joined = joined.withColumn("n", F.size("taken")).withColumn("size", F.col("n") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    plans = stored(_ends_of(joined), "plans")
    first = plans.select("conv_id", "size", F.explode("taken").alias("t")).select("conv_id", F.col("t.k").alias("depth"), *(f"t.{c}" for c in ("a", "b", "a0", "b0", "words", "w0")), "size")
    rest = own.join(plans.drop("taken"), "conv_id").where("k > h")
    return _roots(plans).unionByName(first.select(*_PATH)).unionByName(rest.mapInArrow(_moved, ", ".join(f"{c} long" for c in _PATH)))


def _ends_of(joined: DataFrame) -> DataFrame:
    """Digest and words at the end of the turns taken (ta, tb, tw) and of the own turns that they replace (oa, ob, ow)."""
    at = lambda turns, n, field: F.coalesce(F.when(F.col(n) > 0, F.get(turns, F.col(n) - 1)[field]), F.lit(0).cast("long"))
    words = lambda turns, n: at(turns, n, "w0") + at(turns, n, "words")
    ends = [at("taken", "n", "a").alias("ta"), at("taken", "n", "b").alias("tb"), words("taken", "n").alias("tw"), at("head", "h", "a").alias("oa"), at("head", "h", "b").alias("ob"), words("head", "h").alias("ow")]
    return joined.select("conv_id", "h", "n", F.col("size").cast("long").alias("size"), "taken", *ends)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the replaced ones, put behind the turns taken: of the digests the part after the replaced turns, scaled to its new place."""
    inverse = [np.array([pow(base, -i, 1 << 64) for i in range(SHARED + 1)], np.uint64) for base in BASES]
    for batch in batches:
        k, h, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("k", "h", "n"))
        new = {"depth": k - h + n, "w0": np.asarray(batch.column("w0")) - np.asarray(batch.column("ow")) + np.asarray(batch.column("tw"))}
        for i, name in enumerate("ab"):
            for c in (name, f"{name}0"):
                new[c] = _u(batch.column(f"t{name}")) + inverse[i][h - n] * (_u(batch.column(c)) - _u(batch.column(f"o{name}")))
        yield _columns(batch, **new).select(_PATH)


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for row in range(ROWS):
        yield (mixed(mixed(a + np.uint64(row)) ^ b) & np.uint64(width - 1)).astype(np.int64)


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Counters, at most 2, of the digests (a, b) of rows: an array of ROWS times width."""
    size = width * ROWS // SLICES

    def count(batches) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for row, cells in enumerate(_cells(_u(batch.column("a")), _u(batch.column("b")), width)):
                cells, times = np.unique(cells, return_counts=True)
                at = row * width + cells
                counters[at] = np.minimum(2, counters[at] + np.minimum(times, 2))
        for piece, part in enumerate(counters.reshape(SLICES, size)):
            if part.any():
                yield _sliced(piece, part)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist()):
                part = _unpacked(bits, size)
                held[piece] = np.minimum(2, held[piece] + part) if piece in held else part
        for piece, part in held.items():
            yield _sliced(piece, part)

    pieces = rows.select("a", "b").mapInArrow(count, "piece long, bits binary").repartition("piece").mapInArrow(merge, "piece long, bits binary")
    out = np.zeros((SLICES, size), np.uint8)
    for r in pieces.collect():  # SLICES rows, two bits a counter
        out[r.piece] = _unpacked(r.bits, size)
    return out.reshape(ROWS, width)


def _sliced(piece: int, part: np.ndarray) -> pa.RecordBatch:
    bits = np.packbits(np.stack([part >= 1, part >= 2])).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([bits], pa.binary())], names=["piece", "bits"])


def _unpacked(bits: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * size).reshape(2, size).sum(axis=0, dtype=np.uint8)


def screened(rows: DataFrame, counters: np.ndarray) -> DataFrame:
    """rows with ``single`` and ``parent_single``: whether the sketch proves that the digest, or that of the parent, occurs once."""
    width = counters.shape[1]
    packed = rows.sparkSession.sparkContext.broadcast(np.packbits(counters >= 2).tobytes())

    def once(many: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), bool)
        for row, cells in enumerate(_cells(a, b, width)):
            at = row * width + cells
            found |= many[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 0
        return found

    def work(batches) -> Iterator[pa.RecordBatch]:
        many = np.frombuffer(packed.value, np.uint8)
        for batch in batches:
            a, b, a0, b0 = (_u(batch.column(c)) for c in ("a", "b", "a0", "b0"))
            below = np.asarray(batch.column("depth")) > 1
            yield _columns(batch, single=once(many, a, b), parent_single=below & once(many, a0, b0))

    return rows.mapInArrow(work, ", ".join([*(f"{c} long" for c in _PATH), "single boolean", "parent_single boolean"]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, conv_id) in order to pieces (a, b, first, ids), one for each node and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (np.asarray(batch.column(c)) for c in ("a", "b", "conv_id"))
        cuts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])
        at = cuts[:-1]
        lists = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]), pa.array(lists)], names=["a", "b", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to a SHA-256 for each node; a piece is held at a time."""
    now, digest = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if now == (a, b):
                digest.update(f",{ids}".encode())
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256(ids.encode())
        yield _ends_batch(out)
    if now is not None:
        yield _ends_batch([(*now, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of rows (a, b, conv_id), ids in order and joined by commas: lists are made by ranges, so a node of very many ends is one of few rows when its pieces meet."""
    ranged = rows.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    pieces = ranged.mapInArrow(_listed, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


NOTHING = hashlib.sha256().hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(prefixes: DataFrame, widest: int = WIDEST) -> DataFrame:
    """The nodes of prefixes (as ``paths`` makes them): smallest member, depth, parent's smallest member, members, children, leaves below, words that sharing saves below, and a hash of the members that end there."""
    every = stored(prefixes, "paths")
    deep = every.where("depth > 0")
    width = min(widest, max(NARROWEST, 1 << (4 * deep.count()).bit_length()))
    rows = stored(screened(deep, sketch(deep, width)), "screened")
    single, shared = rows.where("single"), rows.where("NOT single")
    heads = single.where("NOT parent_single")

    groups = shared.groupBy("a", "b").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("a0").alias("a0"), F.min("b0").alias("b0"))
    groups = stored(groups, "shared-nodes")
    children = groups.select("a0", "b0").unionByName(heads.select("a0", "b0")).groupBy(F.col("a0").alias("a"), F.col("b0").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children, "children")
    nodes = stored(groups.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")

    # What a conversation adds above it: the words up to the first node whose smallest member it is, and a leaf if it is that of one.
    met = shared.join(nodes.select("a", "b", "node", "n_children"), ["a", "b"])
    leaf = (F.col("depth") == F.col("size")) & (F.col("n_children") == 0) & (F.col("node") == F.col("conv_id"))
    marks = met.select("conv_id", F.when(F.col("node") != F.col("conv_id"), F.col("w0") + F.col("words")).otherwise(0).alias("saved"), leaf.cast("long").alias("leaf"))
    marks = marks.unionByName(single.where("depth = size").select("conv_id", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf")))
    marks = stored(marks.groupBy("conv_id").agg(F.max("saved").alias("saved"), F.max("leaf").alias("leaf")), "marks")
    sums = shared.join(marks, "conv_id").groupBy("a", "b").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("saved") - F.col("w0"), F.lit(0))).alias("saved_tokens"))

    turnless = every.where("depth = 0 AND size = 0")
    ended = ends(shared.where("depth = size").select("a", "b", "conv_id").unionByName(turnless.select("a", "b", "conv_id")))
    ended = stored(ended, "ends")
    root = _root(every.where("depth = 0"), children, marks, ended)

    whole = nodes.join(sums, ["a", "b"]).join(ended, ["a", "b"], "left")
    inner = _with_parent(whole.select("depth", "a0", "b0", F.col("node").alias("conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), nodes, root)
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("size")
    alone = single.select(
        "depth", "a0", "b0", "conv_id", one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"), "parent_single",
    )
    tails = alone.where("parent_single").withColumn("parent_conv_id", F.col("conv_id")).select(*NODE)
    return root.select(*NODE).unionByName(inner).unionByName(tails).unionByName(_with_parent(alone.where("NOT parent_single"), nodes, root))


def _root(convs: DataFrame, children: DataFrame, marks: DataFrame, ended: DataFrame) -> DataFrame:
    """The row of the node that all conversations begin with; none without conversations. Four rows of totals are collected."""
    total = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    below = marks.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    kids, end = (df.where("a = 0 AND b = 0").first() for df in (children, ended))
    row = (total.conv_id, 0, None, total.n, kids.n_children if kids else 0, below.leaves if kids else 1, below.saved, end.ends_sha256 if end else NOTHING)
    schema = ", ".join(f"{c} {'string' if c == NODE[-1] else 'long'}" for c in NODE)
    return convs.sparkSession.createDataFrame([row] if total.n else [], schema)


def _with_parent(rows: DataFrame, nodes: DataFrame, root: DataFrame) -> DataFrame:
    """rows (NODE but for the parent, a0, b0) with the smallest member of the parent's node: their own where the parent is not among nodes, as it is then known to have one member."""
    parents = nodes.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("node").alias("parent_conv_id"))
    least = root.first()
    top = rows.where("depth = 1").withColumn("parent_conv_id", F.lit(least.conv_id if least else None).cast("long"))
    below = rows.where("depth > 1").join(parents, ["a0", "b0"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return below.select(*NODE).unionByName(top.select(*NODE))
