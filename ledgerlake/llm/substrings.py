"""Substring dedup: relative Lempel-Ziv parsing against an index of reference blocks.

The rule: a window of ``window`` words is a duplicate if the same words also start
in a document with a smaller doc_id; each word that such a window covers goes.

* Reference blocks. Every window has an anchor, the run of ``ANCHOR`` words in it with
  the least hash (leftmost of equals), so equal windows have equal anchors. The windows
  of a document that share an anchor form a block, about 20 words apart; its reach is
  the words of all its windows. All blocks of all documents are indexed by their reach,
  each with the smallest doc_id that has it and the block's place there.
* Factors. A block whose reach is indexed for a smaller doc_id is a match: so many words
  from here are those of that document from there on. Matches that go on in the same
  source at the same distance are one longer match. A document is parsed greedily from
  left to right: the factor at a place is the match that lies there and reaches farthest,
  the next begins where it ends; what no match holds stays literal.
* Factor boundaries. Where an anchor is indexed with several reaches, a copied passage
  starts or ends inside a block. One block of each reach, that of the smallest doc_id,
  then lists its windows, and those that a smaller doc_id lists too are matches as well.
  So factors are exact to the word: they cover what duplicate windows cover, no more.

So only anchors (one of about 20 words) and the windows at boundaries are shuffled;
hot anchors meet in joins that adaptive execution splits, every match has one source,
and nothing is compared pairwise. Hashes of reaches and windows have 128 bits.

Null and empty texts have no words. Rows of a null doc_id are no reference and lose
nothing. Rows with equal doc_id are no references to each other, so repeated rows
get equal results; if their texts differ, a hash of the text tells their matches apart.
Texts of any length are parsed whole. An empty table gives no rows. Extra columns pass;
new ones get underscores where names clash. A kept text is its words joined by single
spaces; in ``removed`` with ``whole`` texts without duplicate windows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_blocks, stored
from .words import Runs, WordHashes, inside, mixed

#: Words of an anchor.
ANCHOR = 10
#: Windows of which anchors are found at once; a bound for the positions packed beside hashes.
STRETCH = 1 << 19
#: Bits of a place in a text, below the text's tag.
TAG = 32


class Parser:
    """Hashes of blocks of texts: anchors, reaches and windows."""

    def __init__(self, window: int):
        self.window, self.words = window, WordHashes()
        self.runs = Runs(0x5851F42D4C957F2D), Runs(0xDA942042E4DD58B5)

    def parse(self, texts: list[bytes]) -> None:
        self.hashes, self.bounds = self.words(texts)
        second = mixed(self.hashes ^ np.uint64(0x6A09E667F3BCC909))
        self.sums = self.runs[0].sums(self.hashes), self.runs[1].sums(second)
        self.starts = np.flatnonzero(inside(self.bounds, self.window, len(self.hashes)))  # of windows
        self.anchors = self._anchors()
        owner = np.searchsorted(self.bounds, self.starts, side="right") - 1
        new = np.ones(len(self.starts), bool)
        new[1:] = (self.anchors[1:] != self.anchors[:-1]) | (owner[1:] != owner[:-1])
        self.first = np.flatnonzero(new)  # of each block, in starts
        self.last = np.append(self.first[1:], len(self.starts))[: len(self.first)] - 1
        self.owner = owner[self.first]
        self.anchor_hash = self.runs[0].all(self.sums[0], ANCHOR)[self.anchors[self.first]]

    def _anchors(self) -> np.ndarray:
        """Place of the anchor of each window."""
        keys, width = self.runs[1].all(self.sums[1], ANCHOR), self.window - ANCHOR + 1
        out = []
        for a in range(0, len(keys) - width + 1, STRETCH):
            part = keys[a : a + STRETCH + width - 1]
            place = np.arange(len(part), dtype=np.uint64)
            least = _sliding_min((part & np.uint64(0xFFFFFFFFFFF00000)) | place, width)
            out.append((least & np.uint64(0xFFFFF)).astype(np.int64) + a)
        return (np.concatenate(out) if out else np.zeros(0, np.int64))[self.starts]

    def reach(self, which: int, blocks: np.ndarray | slice = slice(None)) -> np.ndarray:
        a, b = self.starts[self.first[blocks]], self.starts[self.last[blocks]] + self.window
        return self.runs[which].between(self.sums[which], a, b)

    def of_windows(self, which: int, windows: np.ndarray) -> np.ndarray:
        a = self.starts[windows]
        return self.runs[which].between(self.sums[which], a, a + self.window)

    def within(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the blocks, and for each the block's place in blocks."""
        counts = self.last[blocks] - self.first[blocks] + 1
        which = np.repeat(np.arange(len(blocks)), counts)
        skip = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.first[blocks][which] + skip, which

    def places(self, windows: np.ndarray, owner: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Where windows start in their texts, each below the text's tag."""
        return tags[owner] << TAG | self.starts[windows] - self.bounds[owner]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from minima forward and backward within strips of width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    strips = padded.reshape(-1, width)
    forward = np.minimum.accumulate(strips, axis=1).ravel()
    backward = np.minimum.accumulate(strips[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _tags(texts: list[bytes]) -> np.ndarray:
    """31 bits of each text's hash, which tell rows of one doc_id apart."""
    return np.array([xxhash.xxh3_64_intdigest(t) >> 33 for t in texts], np.int64)


def blocks_of(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, place, words, anchor, r1, r2) of every block of every document."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch, texts in blocks:
            parser.parse(texts)
            ids, words = batch.column("doc_id").take(pa.array(parser.owner)), parser.starts[parser.last] - parser.starts[parser.first] + window
            place = parser.places(parser.first, parser.owner, _tags(texts))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(place), pa.array(words), _signed(parser.anchor_hash), _signed(parser.reach(0)), _signed(parser.reach(1))], names=["doc_id", "place", "words", "anchor", "r1", "r2"]
            )

    return map_blocks(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id long, place long, words long, anchor long, r1 long, r2 long", work)


def _keyed(rows: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of a row of the block and hashes."""
    key = mixed(rows.astype(np.uint64) + np.uint64(1))
    for p in parts:
        key = mixed(key ^ p)
    return key


def _listed(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and fields of all structs in a list column."""
    rows = np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    return rows, [np.asarray(f) for f in column.flatten().flatten()]


def _boundary_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(doc_id, place, w1, w2) of the windows of the blocks in wanted (doc_id, r1)."""
    joined = docs.select("doc_id", "text").join(wanted.groupBy("doc_id").agg(F.collect_set(F.struct("r1")).alias("wanted")), "doc_id")

    def work(blocks) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch, texts in blocks:
            parser.parse(texts)
            rows, (r1,) = _listed(batch.column("wanted"))
            mine = np.flatnonzero(np.isin(_keyed(parser.owner, parser.reach(0)), _keyed(rows, r1.view(np.uint64))))
            windows, which = parser.within(mine)
            owner = parser.owner[mine][which]
            place = parser.places(windows, owner, _tags(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(place), _signed(parser.of_windows(0, windows)), _signed(parser.of_windows(1, windows))], names=["doc_id", "place", "w1", "w2"]
            )

    return map_blocks(joined, "doc_id long, place long, w1 long, w2 long", work)


def _sourced(rows: DataFrame, keys: list[str], least: DataFrame, words: F.Column) -> DataFrame:
    """(doc_id, place, words, source_id, source_place) of the rows whose keys a smaller doc_id has; least: (keys, least)."""
    shared = stored(rows.join(least, keys).select("doc_id", "place", words.alias("words"), *keys, "least"), "shared")
    # Stored, so that adaptive execution can split the hot keys of the join below.
    sources = stored(shared.where("doc_id = least").groupBy(*keys).agg(F.min("place").alias("source_place")), "sources")
    return shared.where("doc_id > least").join(sources, keys).select("doc_id", "place", "words", F.col("least").alias("source_id"), F.col("source_place").bitwiseAND((1 << TAG) - 1).alias("source_place"))


def matches(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, place, words, source_id, source_place): blocks, and windows at factor boundaries, that a smaller doc_id has; place is tagged."""
    blocks = stored(blocks_of(docs, window), "blocks")
    reaches = blocks.groupBy("anchor", "r1", "r2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    reaches = stored(reaches, "reaches")
    known = _sourced(blocks.select("doc_id", "place", "words", "r1", "r2"), ["r1", "r2"], reaches.where("least < most").select("r1", "r2", "least"), F.col("words"))
    anchors = reaches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = reaches.join(anchors, "anchor").select(F.col("least").alias("doc_id"), "r1")
    windows = stored(_boundary_windows(docs, wanted, window), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least")
    return known.unionByName(_sourced(windows, ["w1", "w2"], least, F.lit(window).cast("long")))


def parsed(start: np.ndarray, words: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, words, source, place in it) of one document, from its matches."""
    order = np.lexsort((start, at - start, source))
    start, end, source, shift = start[order], (start + words)[order], source[order], (at - start)[order]
    longer: list[list[int]] = []  # start, end, source, shift; matches that go on are joined
    for a, b, s, d in zip(start.tolist(), end.tolist(), source.tolist(), shift.tolist()):
        if longer and longer[-1][2:] == [s, d] and a <= longer[-1][1]:
            longer[-1][1] = max(longer[-1][1], b)
        else:
            longer.append([a, b, s, d])
    longer.sort()
    out, here, i, best = [], 0, 0, None
    while i < len(longer) or best:
        if best is None or best[1] <= here:
            best = None
            if i < len(longer):
                here = max(here, longer[i][0])
        while i < len(longer) and longer[i][0] <= here:
            if longer[i][1] > here and (best is None or longer[i][1] > best[1]):
                best = longer[i]
            i += 1
        if best is not None:
            out.append((here, best[1] - here, best[2], here + best[3]))
            here = best[1]
    return out


FACTORS = "array<struct<tag: bigint, start: bigint, words: bigint, source_id: bigint, source_start: bigint>>"


def parses(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, factors) of the documents that have factors: tag of the text, start, words, source_id and source_start of each."""
    listed = matches(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("place", "words", "source_id", "source_place")).alias("m"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, (place, words, source, at) = _listed(batch.column("m"))
            tag, start = place >> TAG, place & (1 << TAG) - 1
            out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            order = np.lexsort((tag, rows))
            cuts = np.flatnonzero((np.diff(rows[order]) != 0) | (np.diff(tag[order]) != 0)) + 1
            for part in np.split(order, cuts) if len(order) else []:
                out[rows[part[0]]] += [(int(tag[part[0]]), *f) for f in parsed(start[part], words[part], source[part], at[part])]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("tag", "start", "words", "source_id", "source_start")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("tag", "start", "words", "source_id", "source_start"), f)) for f in x] for x in out], kind)], names=["doc_id", "factors"])

    return listed.mapInArrow(work, f"doc_id long, factors {FACTORS}")


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, start, words, source_id, source_start): the greedy factors of all documents; what they leave out is literal."""
    return parses(docs, window).select("doc_id", F.explode("factors").alias("f")).select("doc_id", "f.start", "f.words", "f.source_id", "f.source_start")


def removed(docs: DataFrame, window: int = 50, whole: bool = False) -> DataFrame:
    """docs with duplicate passages gone from text, and n_words (before) and n_removed.

    whole: leave the texts without duplicates as they are, white space and all.
    """
    columns = docs.columns
    n_words, n_removed, found, owner = (free_name(columns, x) for x in ("n_words", "n_removed", "factors", "owner_id"))
    of = parses(docs, window).select(F.col("doc_id").alias(owner), F.col("factors").alias(found))
    joined = docs.join(of, docs["doc_id"] == F.col(owner), "left").drop(owner)

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            tags, gone = _tags(texts), np.zeros(len(texts), np.int64)
            rows, (tag, start, words, *_) = _listed(batch.column(found))
            mine = np.flatnonzero(tag == tags[rows])
            spans: dict[int, list] = {}
            for r, a, n in zip(rows[mine].tolist(), start[mine].tolist(), words[mine].tolist()):
                spans.setdefault(r, []).append((a, a + n))
                gone[r] += n
            before, kept = [], []
            for i, text in enumerate(texts):
                split = text.split()
                before.append(len(split))
                for a, b in reversed(spans.get(i, [])):
                    del split[a:b]
                kept.append(text if whole and i not in spans else b" ".join(split))
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in columns), pa.array(before, pa.int64()), pa.array(gone)], names=[*columns, n_words, n_removed])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_blocks(joined, ", ".join([*kinds, f"`{n_words}` bigint", f"`{n_removed}` bigint"]), work)
