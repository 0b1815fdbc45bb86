"""SimHash near-dedup: fingerprints joined within a Hamming radius by vantage-point trees.

Distinct fingerprints are partitioned by a vantage-point tree fitted on a bounded
sample: a node sends those within its median distance of its vantage point inside,
the others outside. A pair within radius r that a node parts lies on both sides of
its boundary, so the outer one also visits the inner side if the triangle bound
(distance <= median + r) allows it; a visitor goes on to every side that the bound
leaves open. So each pair meets in exactly one shard of the tree, and each shard is
searched by a smaller tree in memory. A shard returns no pairs but a star for each
group that it joins; groups that shards share are merged by ``components``.

A radius that covers texts of similarity 0.8 leaves no bound that could prune: their
64-bit fingerprints differ in up to 17 bits, those of unrelated texts in 32 +- 4. For
that, ``similar_groups`` takes 1024 bits and joins pieces of them, each of bits drawn at
random: a tree a piece, routed and searched like the above, brings together all rows
whose pieces lie within ``RADIUS``, and pieces are as many as make a pair at similarity
0.8 meet with 99 %. What meets is compared in 256 bits, what is near in all bits. Bits
only propose: both limits are looser than similarity 0.8, and a pair counts if the
shared share of its shingles is 0.8 or more.
A row proposes few partners at a time, those already tied to it never again, and rounds
go on until no pair is left untried, so a large group needs few of its pairs and none is lost.

With 64 bits and unrelated texts distances crowd around 32, and about a third of
the outer rows visit the inner side of each node. See README for what that means at
scale.

Null and empty texts, and texts without words, have fingerprint zero. Null doc_ids
take part but name no group, unless all ids of a group are null. Repeated rows share
a fingerprint, ties of distance are links like others. Texts of any length are read
whole. An empty table gives no rows. Other columns are not read; ``one_of_each`` keeps
them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import free_name, map_blocks, stored, text_blocks
from .components import components
from .words import mixed

#: Shards of the tree at least, and fingerprints that one should own at most (a shard is searched in memory, 8 bytes a point).
SHARDS, SHARD = 16, 65536
#: Points of the sample that fits the tree: so many, or so many for each shard beyond, and never more than the last number (1 MB on the driver).
SAMPLE, SHARD_SAMPLE, MOST_SAMPLE = 8192, 16, 1 << 17
#: Fingerprints that are compared with each other directly, at a leaf of the tree in memory.
LEAF = 256
SEED = 42


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles of width words, lower-cased (A-Z) and joined by spaces; their counts."""
    slices, counts = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= width:
            slices.append([b" ".join(words)] if words else [])
        else:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
            slices.append([joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :])])
        counts.append(len(slices[-1]))
    counts = np.array(counts)
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(slices), repeat(SEED)), np.uint64, int(counts.sum())), counts


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """64-bit SimHash of the shingles of each text."""
    hashes, counts = shingle_hashes(texts, width)
    out = np.zeros(len(texts), np.uint64)
    if len(hashes):
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        most = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little")
        out[full] = most.view(np.uint64).ravel()
    return out


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A word of the bits that most hashes of each text have; counts are positive.

    Eight bits at a time are spread to the bytes of a word and summed there, over
    stretches of at most 255 hashes.
    """
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat((np.cumsum(counts) - counts) - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
    out = np.zeros(len(counts), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(j) & np.uint64(0x0101010101010101), starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):
            out |= (2 * ones[:, lane] > counts).astype(np.uint64) << np.uint64(8 * lane + j)
    return out


def wide_fingerprints_of(texts: list[bytes], width: int, parts: int, sized: bool = False) -> list[bytes]:
    """SimHash of 64 * parts bits of the distinct shingles; parts after the first are of scrambled hashes. No words: zero bits. sized: their number follows, 64 at most."""
    hashes, counts = shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, counts = hashes[new], np.bincount(owner[new], minlength=len(texts))
    out, full = np.zeros((len(texts), parts), np.uint64), np.flatnonzero(counts)
    for part in range(parts if len(full) else 0):
        out[full, part] = _majority(hashes, counts[full])
        hashes = mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    if sized:
        out = np.column_stack([out, np.minimum(counts, LOOSE_FROM[-1]).astype(np.uint64)])
    return [row.tobytes() for row in out]


def fingerprints(docs: DataFrame, width: int = 4, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns and fingerprint (long) of every row."""
    name = free_name(columns, "fingerprint")

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fingerprints_of(texts, width).view(np.int64))], names=[*columns, name])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return map_blocks(docs.select(*dict.fromkeys([*columns, "text"])), ", ".join([*kinds, f"`{name}` bigint"]), work)


def distances(x: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ to).astype(np.int64)


class Tree:
    """A vantage-point tree over a sample; its leaves number the shards."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng)

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        if len(points) > leaf:
            for vantage in rng.choice(points, min(8, len(points)), replace=False):
                d = distances(points, vantage)
                middle = int(np.median(d))
                inner = d <= middle
                if len(points) // 8 <= inner.sum() <= len(points) - len(points) // 8:
                    return vantage, middle, self._grow(points[inner], leaf, rng), self._grow(points[~inner], leaf, rng)
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places of points, whether each is owned there or visits)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, owned = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows, owned
                continue
            vantage, middle, inner, outer = node
            d = distances(points[rows], vantage)
            home = d <= middle
            near = home | (d <= middle + radius)  # owners from outside may only visit inside
            far = ~home | (~owned & (d > middle - radius))
            todo.append((inner, rows[near], owned[near] & home[near]))
            todo.append((outer, rows[far], owned[far]))


class Groups:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)])[:, a != b], axis=1)
        root = self.root
        for x, y in pairs.T.tolist():
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while pairs.size and (next_root := root[root]).tolist() != root.tolist():
            root = self.root = next_root


def _joined(points: np.ndarray, owned: np.ndarray, radius: int) -> np.ndarray:
    """For each point the place of its group's first; pairs of visitors are left to other shards."""
    groups = Groups(len(points))
    for a, b in _near(points, owned, radius):
        groups.join(a, b)
    return groups.root


def _near(points: np.ndarray, owned: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the points of a shard within radius of each other, each pair in one or both orders; the first is owned."""
    if not owned.any():
        return
    tree = Tree(points[owned], LEAF, np.random.default_rng(1))
    leaves: dict[int, list] = {}
    own = np.flatnonzero(owned)
    for leaf, rows, mine in tree.route(points[own], radius):
        leaves[leaf] = [own[rows[mine]], own[rows[~mine]]]
    visitors = np.flatnonzero(~owned)
    if len(visitors):
        for leaf, rows in _visits(tree, points[visitors], radius):
            if leaf in leaves:
                leaves[leaf][1] = np.concatenate([leaves[leaf][1], visitors[rows]])
    for mine, others in leaves.values():
        for a in range(0, len(mine), LEAF):
            part = mine[a : a + LEAF]
            for other, rest in ((mine[a:], True), (others, False)):
                for b in range(0, len(other), 1 << 14):
                    near = np.bitwise_count(points[part][:, None] ^ points[other[b : b + (1 << 14)]]) <= radius
                    i, j = np.nonzero(near)
                    if len(i):
                        yield part[i], other[b + j]


def _visits(tree: Tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves that may hold a point within radius of each visitor."""
    todo = [(tree.root, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        vantage, middle, inner, outer = node
        d = distances(points[rows], vantage)
        todo.append((inner, rows[d <= middle + radius]))
        todo.append((outer, rows[d > middle - radius]))


def _sample(prints: DataFrame, n: int) -> list[Row]:
    """Rows of prints (n rows) that fit a tree."""
    size = min(MOST_SAMPLE, max(SAMPLE, SHARD_SAMPLE * (n // SHARD)))
    return prints.sample(min(0.25, 1.2 * size / n), 11).limit(size).collect()


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a > b, of distinct fingerprints (column fingerprint); their components are those of all pairs within radius."""
    n = prints.count()
    sample = np.zeros(0, np.uint64)
    own = min(SHARD, max(LEAF, n // SHARDS))
    if n > own:
        rows = _sample(prints, n)
        sample = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64)
    tree = Tree(sample, max(8, len(sample) * own // max(n, 1)), np.random.default_rng(0))

    def route(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fingerprint")
            for shard, rows, owned in tree.route(np.asarray(points).view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), points.take(pa.array(rows)), pa.array(owned)], names=["shard", "fingerprint", "owned"])

    def search(table: pa.Table) -> pa.Table:
        points = table.column("fingerprint").to_numpy().view(np.uint64)
        root = _joined(points, table.column("owned").to_numpy(), radius)
        tied = np.flatnonzero(root != np.arange(len(points)))
        a, b = points[tied].view(np.int64), points[root[tied]].view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    routed = prints.select("fingerprint").mapInArrow(route, "shard long, fingerprint long, owned boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """prints (doc_id, fingerprint) with component_id, the smallest doc_id that links reach."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, radius))
    tied = roots.select(F.col("node").alias("fingerprint"), "root").unionByName(roots.select(F.col("root").alias("fingerprint"), "root").distinct())
    least = distinct.join(tied, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    named = tied.join(least, "root").select("fingerprint", "component_id")
    classes = distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    # Stored, so that adaptive execution can split the rows of a frequent fingerprint.
    return prints.join(stored(classes, "classes"), "fingerprint")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = stored(fingerprints(docs, width), "prints")
    return grouped(prints, radius)


#: 64-bit words of a wide fingerprint, and of its head, in which rows that meet are compared first.
WORDS, HEAD = 16, 4
#: Least Jaccard similarity of a pair, as a fraction; it decides, on the shingles themselves.
SIMILAR = (4, 5)
#: Share of bits in which texts of Jaccard similarity 0.8 differ: arccos(2 * 0.8 / 1.8) / pi = 0.1515, and one
#: standard deviation of 1024 bits. Pieces are drawn for it.
SPREAD = 0.165
#: Share of all bits up to which a pair is proposed, by the shingles of the smaller text at least: of few shingles a lost
#: one moves more bits (4 of 5 lie at 0.19). Each is three standard deviations above the mean at similarity 0.8.
LOOSE, LOOSE_FROM = (0.23, 0.20, 0.187), (0, 7, 64)
#: Partners that a row proposes of those near by a piece in the first round; GROWTH times as many in each later one.
TRIES, GROWTH = 16, 16
#: Rows and pairs that one group of the exact comparison should hold; it keeps the shingle hashes of their texts.
CHUNK_ROWS, CHUNK_PAIRS = 1024, 1 << 15
#: Share of a head's bits in which similar texts may differ: five standard deviations of 256 bits (unrelated: 0.5 +- 0.03).
COARSE = 0.28
#: Bits in which the pieces of two fingerprints may differ for the pair to meet. More would need fewer pieces, but leave the tree less to prune.
RADIUS = 1
#: Unrelated fingerprints whose piece should lie within RADIUS of a row's on average; share of the pairs at SPREAD that should meet.
BUCKET, MEET = 256, 0.99


def pieces_for(n: int) -> np.ndarray:
    """Bits of each piece, drawn at random: so many that about BUCKET of n rows lie within RADIUS of a row, and pieces enough for MEET."""
    width, off = 8, 1.15 * SPREAD
    while n * sum(comb(width, d) for d in range(RADIUS + 1)) > BUCKET << width:
        width += 1
    near = sum(comb(width, d) * off**d * (1 - off) ** (width - d) for d in range(RADIUS + 1))
    rng = np.random.default_rng(5)
    return np.stack([rng.choice(64 * WORDS, width, replace=False) for _ in range(int(np.ceil(np.log(1 - MEET) / np.log(1 - near))))])


def _values(points: np.ndarray, pieces: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers that the bits of each piece spell, for all rows."""
    bits = np.unpackbits(np.ascontiguousarray(points[:, :WORDS]).view(np.uint8), axis=1, bitorder="little")
    for places in pieces:
        yield (bits[:, places].astype(np.uint64) << np.arange(len(places), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def trees_for(prints: DataFrame, n: int, pieces: np.ndarray) -> list[Tree]:
    """A vantage-point tree for each piece, whose shards own at most about SHARD of the n prints."""
    sample = np.zeros((0, WORDS), np.uint64)
    own = min(SHARD, max(LEAF, n // SHARDS))
    if n > own:
        sample = _words(pa.array([bytes(r.print) for r in _sample(prints.select("print"), n)], pa.binary()), WORDS)
    rng = np.random.default_rng(0)
    return [Tree(values, max(8, len(sample) * own // max(n, 1)), rng) for values in _values(sample, pieces)]


def _words(column: pa.Array, none: int = 0) -> np.ndarray:
    """Rows of a binary column of equal sizes as rows of 64-bit words (a column without rows: none of them)."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(column), -1 if len(column) else none)


class Balls:
    """For each row its candidates: of rows sorted by key those of its key and of the keys tied to it, by pairs (x, y) of places of distinct keys.

    Candidates lie at ``rows[begin:end]``; with labels they are sorted by them.
    """

    def __init__(self, keys: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, labels: np.ndarray | None = None):
        _, first, at, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        if pairs is None:
            self.rows, self.begin, self.end = np.arange(len(keys)), first[at], (first + counts)[at]
            return
        x, y = np.unique(np.concatenate([np.stack(pairs), np.stack(pairs[::-1])], axis=1), axis=1)  # sorted by x
        ends = np.cumsum(counts[y])
        self.rows = np.arange(int(counts[y].sum())) + np.repeat(first[y] - (ends - counts[y]), counts[y])
        if labels is not None:
            self.rows = self.rows[np.lexsort((labels[self.rows], np.repeat(x, counts[y])))]
        bounds = np.concatenate([[0], ends])
        self.begin, self.end = (bounds[np.searchsorted(x, np.arange(len(first)), side=side)][at] for side in ("left", "right"))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of x and y differ."""
    return np.bitwise_count(x ^ y).sum(axis=1)


def _touching(keys: np.ndarray, heads: np.ndarray, balls: Balls | None = None) -> np.ndarray:
    """Rows, sorted by key, that are near another one of their candidates (without balls: the rows of their key).

    A row looks on until it has a neighbour, so a large group of near rows costs its size, not its square.
    """
    balls = balls or Balls(keys)
    found = np.zeros(len(keys), bool)
    first, step = np.arange(len(keys)), 0
    while len(first := first[~found[first] & (balls.begin[first] + step < balls.end[first])]):
        other = balls.rows[balls.begin[first] + step]
        near = (other != first) & (_apart(heads[first], heads[other]) <= 64 * HEAD * COARSE)
        found[first[near]] = found[other[near]] = True
        step += 1
    return np.flatnonzero(found)


def _limits(points: np.ndarray) -> np.ndarray:
    """Bits in which a row may differ from one that it proposes; a word behind the bits, if there, is the number of its shingles."""
    sizes = points[:, WORDS].astype(np.int64) if points.shape[1] > WORDS else np.zeros(len(points), np.int64)
    return 64 * WORDS * np.array(LOOSE)[np.searchsorted(LOOSE_FROM, sizes, side="right") - 1]


def _proposed(
    keys: np.ndarray, points: np.ndarray, nodes: np.ndarray, labels: np.ndarray, refused: list, tries: int, balls: Balls | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by key and label, and their candidates (without balls: the rows of their key) that are near and neither of a label nor
    refused: for each row at most ``tries`` of lesser labels, the least first; and the rows that have more.

    All rows of a large group so turn to the same few, by every piece, and their pairs are few when pieces are put together.
    """
    balls, limits = balls or Balls(keys), _limits(points)
    left, more = np.full(len(keys), tries), np.zeros(len(keys), bool)
    first, step, found = np.arange(len(keys)), 0, [np.zeros((2, 0), np.int64)]
    while len(first := first[(balls.begin[first] + step < balls.end[first]) & ~more[first]]):
        other = balls.rows[balls.begin[first] + step]
        lesser = labels[other] < labels[first]  # those after it are none either
        first, other = first[lesser], other[lesser]
        close = _apart(points[first, :HEAD], points[other, :HEAD]) <= 64 * HEAD * COARSE
        near, other = first[close], other[close]
        close = _apart(points[near, :WORDS], points[other, :WORDS]) <= np.maximum(limits[near], limits[other])
        near, other = near[close], other[close]
        new = np.array([not (refused[i] and m in refused[i] or refused[j] and n in refused[j]) for i, j, n, m in zip(near.tolist(), other.tolist(), nodes[near].tolist(), nodes[other].tolist())], bool)
        near, other = near[new], other[new]
        more[near[left[near] == 0]] = True
        some = left[near] > 0
        near, other = near[some], other[some]
        left[near] -= 1
        found.append(np.stack([near, other]))
        step += 1
    return *np.concatenate(found, axis=1), np.flatnonzero(more)


def _met(
    rows: DataFrame, pieces: np.ndarray, trees: list[Tree], order: str, work: Callable[[np.ndarray, tuple, pa.Table], pa.RecordBatch], schema: str, size: int | None = None
) -> DataFrame:
    """What work gives for the shards of each piece's tree: of the values of their rows, sorted by value and order, of the places of distinct values
    within RADIUS of each other, and of the rows (node, print, of which size bytes are sent, ...)."""
    most = max(tree.leaves for tree in trees)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pc.binary_slice(c, 0, size) if size and name == "print" else c for name, c in zip(batch.schema.names, batch.columns)]
            for i, (values, tree) in enumerate(zip(_values(_words(batch.column("print"), WORDS), pieces), trees)):
                routed = [(np.full(len(at), i * most + shard), at, owned) for shard, at, owned in tree.route(values, RADIUS)]
                if routed:
                    shard, at, owned = (np.concatenate(x) for x in zip(*routed))
                    dealt = [pa.array(shard), pa.array(values[at].view(np.int64)), pa.array(owned), *(c.take(pa.array(at)) for c in columns)]
                    yield pa.RecordBatch.from_arrays(dealt, names=["shard", "value", "owned", *batch.schema.names])

    def met(table: pa.Table) -> pa.RecordBatch:
        values = table.column("value").to_numpy().view(np.uint64)
        distinct, first = np.unique(values, return_index=True)
        pairs = [np.zeros((2, 0), np.int64), *map(np.stack, _near(distinct, table.column("owned").to_numpy()[first], RADIUS))]
        return work(values, tuple(np.concatenate(pairs, axis=1)), table.drop_columns(["shard", "value", "owned"]))

    def search(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if len(part):
                    if held and held[0].column("shard")[0].as_py() != shards[part[0]]:
                        yield met(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(part[0], len(part)))
        if held:
            yield met(pa.Table.from_batches(held))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(deal, f"shard long, value long, owned boolean, {kinds}")
    return dealt.repartition("shard").sortWithinPartitions("shard", "value", *([order] if order else [])).mapInArrow(search, schema)


def _lists(node: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """For each row with pairs, or more of them: its node (a), the nodes that it proposes (bs) and whether it has more."""
    rows, order = np.unique(np.concatenate([a, more])), np.argsort(a, kind="stable")
    offsets = np.concatenate([[0], np.searchsorted(a[order], rows, side="right")])
    bs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[b[order]], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(node[rows], pa.int64()), bs, pa.array(np.isin(rows, more))], names=["a", "bs", "more"])


def _all_similar(found: DataFrame) -> DataFrame:
    pairs = found.select("a", F.explode("bs").alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.expr("cast(NULL AS array<bigint>)").alias("refused"))


def wide_links(prints: DataFrame, judged: Callable[[DataFrame], DataFrame] = _all_similar) -> DataFrame:
    """Edges (a, b), a > b, of distinct prints (node, print): of the near pairs those that ``judged`` finds similar, but for such as
    others imply. Heads alone find the few rows that have a neighbour, these are compared in full.

    ``judged`` takes rows (a, bs) and gives edges (a, b) and, with b null, the nodes that a is not similar to (refused).
    """
    n = prints.count()
    pieces = pieces_for(n)
    trees = trees_for(prints, n, pieces)

    def touch(values, pairs, table) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()[_touching(values, _words(table.column("print")), Balls(values, pairs))]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(nodes), pa.int64())], names=["node"])

    touched = _met(prints.select("node", "print"), pieces, trees, "", touch, "node long", size=8 * HEAD)
    nodes = stored(prints.join(stored(touched.distinct(), "touched"), "node", "left_semi"), "near-prints")

    def proposals(rows: DataFrame, tries: int) -> DataFrame:
        def propose(values, pairs, table) -> pa.RecordBatch:
            node, label = (table.column(c).to_numpy() for c in ("node", "label"))
            refused = [x and set(x) for x in table.column("refused").to_pylist()]
            return _lists(node, *_proposed(values, _words(table.column("print")), node, label, refused, tries, Balls(values, pairs, label)))

        dealt = _met(rows, pieces, trees, "label", propose, "a long, bs array<bigint>, more boolean")
        return stored(dealt.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"), F.max("more").alias("more")), "proposals")

    rows, tries, tried = nodes.withColumn("label", F.col("node")).withColumn("refused", F.expr("cast(NULL AS array<bigint>)")), TRIES, None
    while True:
        found = proposals(rows, tries)
        verdicts = stored(judged(found.where("size(bs) > 0").select("a", "bs")), "verdicts")
        tried = verdicts if tried is None else tried.unionByName(verdicts)
        edges = tried.where("b IS NOT NULL").select("a", "b")
        if not found.where("more").take(1):
            return edges
        refused = tried.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.flatten(F.collect_list("refused")).alias("refused"))
        roots = _with_roots(components(edges))
        rows = nodes.join(roots, "node", "left").join(refused, "node", "left").select("node", "print", F.coalesce("root", "node").alias("label"), "refused")
        tries *= GROWTH


def _with_roots(roots: DataFrame) -> DataFrame:
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def chunked(found: DataFrame) -> DataFrame:
    """found (a, bs) with ``chunk``: rows that turn to the same least partner are side by side, so a chunk has few partners of its own."""
    rows, pairs = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("bs")), F.lit(0))).first()
    ranged = found.repartitionByRange(max(1, -(-rows // CHUNK_ROWS), -(-pairs // CHUNK_PAIRS)), F.array_min("bs"), F.col("a"))
    return stored(ranged.withColumn("chunk", F.spark_partition_id()), "chunks")


def judge(chunks: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """What ``wide_links`` asks for of chunks (a, bs, chunk), from the distinct shingles of the texts (node, text).

    Each text goes to a chunk once, however many of its pairs it is in; similar pairs leave a chunk as a star for each group.
    """

    def work(rows: pa.Table, near: pa.Table) -> pa.Table:
        sets = {}
        for batch, block in text_blocks(near.combine_chunks().to_batches()):
            hashes, counts = shingle_hashes(block, width)
            sets |= zip(batch.column("node").to_pylist(), map(np.unique, np.split(hashes, np.cumsum(counts)[:-1])))
        nodes = np.array(sorted(sets), np.int64)
        place = {n: i for i, n in enumerate(nodes.tolist())}
        groups, refused = Groups(len(nodes)), {}
        for a, bs in zip(rows.column("a").to_pylist(), rows.column("bs").to_pylist()):
            x, tied, apart = sets[a], [], []
            for b in bs:
                y = sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True)) if SIMILAR[1] * min(len(x), len(y)) >= SIMILAR[0] * max(len(x), len(y)) else 0
                (tied if SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both) else apart).append(b)
            if tied:
                groups.join(np.full(len(tied), place[a]), np.array([place[b] for b in tied]))
            if apart:
                refused[a] = apart
        low = np.flatnonzero(groups.root != np.arange(len(nodes)))
        ends = [*nodes[groups.root[low]].tolist(), *[None] * len(refused)]
        return pa.table({
            "a": pa.array([*nodes[low].tolist(), *refused], pa.int64()),
            "b": pa.array(ends, pa.int64()),
            "refused": pa.array([*[None] * len(low), *refused.values()], pa.list_(pa.int64())),
        })

    wanted = chunks.select("chunk", F.explode(F.array_append("bs", F.col("a"))).alias("node")).distinct()
    sided = wanted.join(texts, "node").select(F.col("chunk").alias("of"), "node", "text")
    return chunks.groupBy("chunk").cogroup(sided.groupBy("of")).applyInArrow(work, "a long, b long, refused array<bigint>")


def similar_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, th, component): groups of rows by similarity of their shingles; th is the text's hash.

    Rows of equal wide fingerprints are one node: their sets of shingles differ in a few of thousands at most.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            prints = wide_fingerprints_of(texts, width, WORDS, sized=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(prints, pa.binary())], names=["doc_id", "th", "print"])

    prints = stored(map_blocks(keyed, "doc_id long, th long, print binary", work).withColumn("node", F.xxhash64("print")), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    distinct = stored(prints.groupBy("node").agg(F.min("print").alias("print"), F.min(row).alias("row")), "prints-distinct")

    def judged(found: DataFrame) -> DataFrame:
        chunks = chunked(found)
        ends = chunks.select(F.explode(F.array_append("bs", F.col("a"))).alias("node")).distinct()
        ends = distinct.join(ends, "node", "left_semi").select("node", F.col("row.doc_id").alias("__doc"), F.col("row.th").alias("__th"))
        texts = keyed.join(ends, keyed["doc_id"].eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))).select("node", F.coalesce("text", F.lit("")).alias("text"))
        return judge(chunks, stored(texts.dropDuplicates(["node"]), "near-texts"), width)

    roots = components(wide_links(distinct.select("node", "print"), judged))
    return prints.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("component"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each group of similar texts, that of the smallest doc_id (null last), then text hash; rows without words all stay."""
    th, doc, hash_ = (free_name(docs.columns, x) for x in ("text_hash", "first_doc", "first_hash"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    worded = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    first = similar_groups(docs.where(worded), width).groupBy("component").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias(doc), F.col("m.th").alias(hash_))
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = keyed.where(worded).join(first, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(th) == F.col(hash_)), "left_semi").dropDuplicates(["doc_id", th])
    return chosen.unionByName(keyed.where(~worded)).select(*docs.columns)
