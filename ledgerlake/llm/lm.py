"""LM scoring with an Elias-Fano trie of word n-grams.

The model. Its outcomes are the V distinct training tokens and one class of unknown
tokens, as in the base score. A token is predicted after its two predecessors: first as
one of the ``PREDICTED`` most frequent words, the end, or the class of all other words
(known or not); then, within that class, by its own count: c / (R + V), where R counts
the class's training tokens and an unknown token has V. Contexts are words of any
frequency. With n occurrences after a context of C, an n-gram that occurs ``KEPT`` times
or more has (n - d) / C, d from ``DISCOUNTS``; rarer ones count in C but are not kept.
What is left over goes to the shorter context (one word, then none), and all orders are
added up, so the probabilities after any context sum to 1.

The trie. Contexts are stored nearest word first: a level holds the contexts, and for
each its followers. Both are one monotone sequence a level, parent and word, coded by
Elias and Fano, so a successor is looked up relative to its context. Probabilities
and back-off weights are quantised to 16 bits. A trie is one buffer whose arrays are
views, so that it can be memory-mapped. Tries are built for slices of the contexts,
of about ``SLICE_TOKENS`` tokens each, and queried where they are built.

The jobs. Words are 64-bit hashes. (1) Words are counted in the tasks, then by a shuffle.
(2) Each task cuts its tokens into packets, one for each slice of contexts and one for
each slice of rare words: sorted, in byte planes, compressed. (3) A slice counts the
n-grams (or rare words) of its packets, builds its trie, and answers each packet with
a sum for each document. (4) The answers of a block of documents meet its header. Sums
of quantised values are whole numbers, so scores do not depend on any order.

Hot contexts. The occurrences of a word with more than an eighth of a slice are dealt to
several slices by the word before it, and those of such a pair by the word after it. What
a slice then cannot count itself is counted first, over all documents: the followers
of hot words, by a plain aggregation whose results each slice of the word gets, packed, and four sums for each hot
context, held by every task. The numbers are those that one slice would find, so
scores do not depend on ``slice_tokens``. Which pairs are hot is guessed from a sample of about
``PAIR_SAMPLE`` tokens; a wrong guess makes a slice larger or smaller. The second context
word counts by 32 bits of a hash, the first by 40 bits unless it is predicted: words of equal bits share a context.

Null and empty texts are the end token alone. Null doc_ids count as the empty text and
so train. Repeated rows train and are scored as often as they occur. Texts of any
length are handled; one longer than ``BLOCK_TOKENS`` is a block of its own. Other
columns are not read. Without training rows every token is unknown, of probability 1.
An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_blocks, stored
from .words import WordHashes, mixed

#: Words that are predicted one by one; all others are predicted as a class, then by their counts.
PREDICTED = 1 << 17
#: Occurrences of an n-gram that is kept, at least; the discounts of those that occur so often, and more often.
KEPT, DISCOUNTS = 2, (1.0, 1.4)
#: Tokens of a slice of contexts, and of a block of documents, about.
SLICE_TOKENS, BLOCK_TOKENS = 1_000_000, 1_000_000
#: Distinct words that a task counts before it hands the counts on.
HELD_WORDS = 1_000_000
#: Tokens of a text block, and distinct keys, of the counts of hot contexts in a task.
COUNTED, HELD_KEYS = 250_000, 500_000
FOLDS, HELD_OUT = 7, 2
#: Steps of a quantised log10.
STEPS = 2048
#: Tokens, about, of the sample in which hot pairs are looked for.
PAIR_SAMPLE = 4_000_000
# Symbols: the end, words 1.., the class of rare words, what stands before a text; contexts also have words of 40 bits.
END, RARE, BEFORE = 0, PREDICTED + 1, PREDICTED + 2
_WORD = PREDICTED + 3
#: Bits of a predicted symbol, and of the second context word below the first.
SYMBOL, SECOND = 18, 32
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b""))


class EliasFano:
    """A strictly rising sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel()
        low = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)])
        unary = np.zeros(n + (universe >> low_bits) + 2, np.uint8)
        unary[(values >> low_bits) + np.arange(n)] = 1
        unary = np.concatenate([unary, np.zeros(-len(unary) % 64, np.uint8)])
        zeros = np.concatenate([[0], np.cumsum(64 - unary.reshape(-1, 64).sum(axis=1, dtype=np.int64))]).astype(np.uint32)
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), zeros)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        byte = at >> 3
        word = sum(self.low[byte + k].astype(np.int64) << 8 * k for k in range(-(-(self.low_bits + 7) // 8)))
        return word >> (at & 7) & (1 << self.low_bits) - 1

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have high parts below high: the place of the high-th zero, less high."""
        block = np.searchsorted(self.zeros, high, side="left") - 1
        block = np.maximum(block, 0)
        left = high - self.zeros[block].astype(np.int64)  # the left-th zero of the block
        bits = np.unpackbits(self.high.reshape(-1, 8)[block], axis=1, bitorder="little")
        passed = (np.cumsum(bits == 0, axis=1, dtype=np.uint8) < left[:, None]).sum(axis=1)
        place = np.where(high > 0, block * 64 + passed, -1)
        return place - high + 1

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = values >> self.low_bits
        top = int(self.zeros[-1])
        ok = np.flatnonzero(high + 1 <= top)
        a, b = self._before(high[ok]), self._before(high[ok] + 1)
        want = values[ok] & (1 << self.low_bits) - 1
        while (open_ := a < b).any():
            rows = np.flatnonzero(open_)
            mid = (a[rows] + b[rows]) >> 1
            low = self._lows(mid)
            hit, less = low == want[rows], low < want[rows]
            out[ok[rows[hit]]] = mid[hit]
            a[rows[less]] = mid[less] + 1
            b[rows[~less & ~hit]] = mid[~less & ~hit]
            b[rows[hit]] = a[rows[hit]]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.zeros))
        return b"".join([head, self.low.tobytes(), self.high.tobytes(), self.zeros.astype("<u4").tobytes()])

    @classmethod
    def view(cls, data, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QIIII", data, at)
        at += struct.calcsize("<QIIII")
        low, high = np.frombuffer(data, "u1", a, at), np.frombuffer(data, "u1", b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype("<u2")


class Grams:
    """Occurrences (nearest context, hash of the second, symbol), with ids of what is equal among them."""

    def __init__(self, near: np.ndarray, second: np.ndarray, symbol: np.ndarray):
        self.near, a = np.unique(near, return_inverse=True)
        a = a.astype(np.int64)
        self.pairs, p = np.unique(a << SECOND | second, return_inverse=True)
        self.followers, self.follower = np.unique(a << SYMBOL | symbol, return_inverse=True)
        self.triples, first, self.triple = np.unique(p.astype(np.int64) << SYMBOL | symbol, return_index=True, return_inverse=True)
        self.a, self.p, self.follower_of = a, p, self.follower[first]


def _sums(context: np.ndarray, n: np.ndarray, contexts: int) -> np.ndarray:
    """For each context its occurrences, those of followers that are kept, and how many followers occur KEPT times, or more often; n: of each follower."""
    kept = n >= KEPT
    return np.stack([np.bincount(context, w, contexts) for w in (n, np.where(kept, n, 0), n == KEPT, n > KEPT)])


class Hot:
    """What a slice is told of contexts that are spread over slices: their sums, and the followers of single words."""

    def __init__(self, known: Vocabulary, keys: np.ndarray, counts: np.ndarray):
        self.known, order = known, np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]  # word << SYMBOL | follower

    def replace_followers(self, grams: Grams, n: np.ndarray, sums: np.ndarray) -> None:
        at, there = _places(self.known.hot_words, grams.near)
        sums[:, there] = self.known.word_sums[:, at[there]]
        mine = np.zeros(len(grams.near), bool)
        mine[there] = True
        rows = np.flatnonzero(mine[grams.followers >> SYMBOL])
        keys = grams.near[grams.followers[rows] >> SYMBOL] << SYMBOL | grams.followers[rows] & (1 << SYMBOL) - 1
        at, there = _places(self.keys, keys)
        n[rows] = 0
        n[rows[there]] = self.counts[at[there]]

    def replace_pairs(self, grams: Grams, sums: np.ndarray) -> None:
        near = grams.near[grams.pairs >> SECOND]
        some = np.flatnonzero(near <= BEFORE)
        at, there = _places(self.known.hot_pairs, near[some] << SECOND | grams.pairs[some] & (1 << SECOND) - 1)
        sums[:, some[there]] = self.known.pair_sums[:, at[there]]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted keys each of wanted would stand, and which of wanted are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, np.flatnonzero(keys[at] == wanted)


class Trie:
    """Levels of contexts: their back-off weights, followers and probabilities."""

    def __init__(self, levels: list[tuple[EliasFano, np.ndarray, EliasFano, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, grams: Grams, train: np.ndarray, first: np.ndarray, hot: Hot | None = None) -> Trie:
        """Of the occurrences in training (weight 1; others 0); first: probabilities of symbols without a context; hot: counts of contexts that are spread over slices."""
        mask = (1 << SYMBOL) - 1

        def level(keys: np.ndarray, n: np.ndarray, sums: np.ndarray, lower) -> tuple:
            """keys: context and symbol, n: their occurrences, sums: of contexts, see ``_sums``."""
            keep = np.flatnonzero(n >= KEPT)
            node, symbol, n = keys[keep] >> SYMBOL, keys[keep] & mask, n[keep]
            own = (n - np.where(n > KEPT, DISCOUNTS[1], DISCOUNTS[0])) / sums[0][node]
            left = 1 - (sums[1] - DISCOUNTS[0] * sums[2] - DISCOUNTS[1] * sums[3]) / np.maximum(sums[0], 1)
            return node, symbol, own + left[node] * lower(keep, symbol), left

        n = np.bincount(grams.follower, train, len(grams.followers))
        sums = _sums(grams.followers >> SYMBOL, n, len(grams.near))
        if hot is not None:
            hot.replace_followers(grams, n, sums)
        a, x, p, left = level(grams.followers, n, sums, lambda keep, symbol: first[symbol])
        shorter = np.ones(len(grams.followers))
        shorter[np.searchsorted(grams.followers, a << SYMBOL | x)] = p
        nodes = np.flatnonzero(sums[1])  # contexts that keep followers, be they in this slice or not
        levels = [(EliasFano.build(grams.near[nodes]), _quantised(left[nodes]), EliasFano.build(np.searchsorted(nodes, a) << SYMBOL | x), _quantised(p))]
        n = np.bincount(grams.triple, train, len(grams.triples))
        sums = _sums(grams.triples >> SYMBOL, n, len(grams.pairs))
        if hot is not None:
            hot.replace_pairs(grams, sums)
        pair, x, p, left = level(grams.triples, n, sums, lambda keep, symbol: shorter[grams.follower_of[keep]])
        found = np.flatnonzero(sums[1])
        keys = grams.pairs[found]
        keys = np.searchsorted(nodes, keys >> SECOND) << SECOND | keys & (1 << SECOND) - 1
        levels.append((EliasFano.build(keys), _quantised(left[found]), EliasFano.build(np.searchsorted(found, pair) << SYMBOL | x), _quantised(p)))
        return cls(levels)

    def steps(self, grams: Grams, first: np.ndarray) -> np.ndarray:
        """-log10 of the probability of each distinct triple's symbol after its contexts, in steps; first: of symbols without a context."""
        mask = (1 << SYMBOL) - 1
        (contexts, weights, followers, values), (contexts2, weights2, followers2, values2) = self.levels
        node = contexts.find(grams.near)
        short = self._level(node[grams.followers >> SYMBOL], grams.followers & mask, weights, followers, values, first[grams.followers & mask])
        above = node[grams.pairs >> SECOND]
        inner, known = np.full(len(grams.pairs), -1, np.int64), np.flatnonzero(above >= 0)
        inner[known] = contexts2.find(above[known] << SECOND | grams.pairs[known] & (1 << SECOND) - 1)
        return self._level(inner[grams.triples >> SYMBOL], grams.triples & mask, weights2, followers2, values2, short[grams.follower_of])

    @staticmethod
    def _level(node: np.ndarray, symbol: np.ndarray, weights: np.ndarray, followers: EliasFano, values: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        out, live = shorter.copy(), np.flatnonzero(node >= 0)
        hit = followers.find(node[live] << SYMBOL | symbol[live])
        out[live] += weights[node[live]]
        out[live[hit >= 0]] = values[hit[hit >= 0]]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([part for contexts, weights, followers, values in self.levels for part in (contexts.to_bytes(), weights.tobytes(), followers.to_bytes(), values.tobytes())])

    @classmethod
    def view(cls, data) -> Trie:
        """The trie in a buffer (bytes, or a memory map), without copies."""
        at, levels = 0, []
        for _ in range(2):
            contexts, at = EliasFano.view(data, at)
            weights = np.frombuffer(data, "<u2", contexts.n, at)
            followers, at = EliasFano.view(data, at + 2 * contexts.n)
            levels.append((contexts, weights, followers, np.frombuffer(data, "<u2", followers.n, at)))
            at += 2 * followers.n
        return cls(levels)


def in_training(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT for i in doc_ids], bool)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all words and the end token, as hashes; c: in training rows."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        hashes_of, held = WordHashes(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def handed_on(held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["word", "c"])

        for batch, texts in blocks:
            train = in_training(batch.column("doc_id").to_pylist())
            hashes, bounds = hashes_of([t.lower() for t in texts])
            words = np.concatenate([held[0], hashes, [END_HASH]])
            counts = np.concatenate([held[1], np.repeat(train, np.diff(bounds)), [train.sum()]])
            distinct, which = np.unique(words, return_inverse=True)
            held = distinct, np.bincount(which, counts).astype(np.int64)
            if len(distinct) > HELD_WORDS:
                yield handed_on(held)
                held = held[0][:0], held[1][:0]
        if len(held[0]):
            yield handed_on(held)

    return map_blocks(docs.select("doc_id", "text"), "word long, c long", work).groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task knows of the words: hashes and counts of those that are predicted, and totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, tokens: int, kinds: int, slice_tokens: int):
        order = np.argsort(hashes)
        self.hashes, self.symbol = hashes[order], order + 1
        self.tokens, self.kinds, self.ends = tokens, kinds, ends
        self.count = np.zeros(RARE + 1, np.int64)
        self.count[END] = ends
        self.count[1 : len(counts) + 1] = counts
        self.rare = tokens - int(self.count.sum())
        self.slices = max(1, -(-tokens // slice_tokens))
        self.rare_slices = max(1, -(-self.rare // slice_tokens))
        self.most = most = max(1, slice_tokens // 8)
        big = np.append(self.count, ends)  # before a text stand as many contexts as there are texts
        self.is_hot = big > most
        self.hot_words = np.flatnonzero(self.is_hot)
        self.pieces = np.ones(BEFORE + 1, np.int64)
        self.pieces[self.hot_words] = -(-big[self.hot_words] // most)
        self.word_sums = np.zeros((4, len(self.hot_words)))
        self.set_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def set_pairs(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        """Pairs (word << SECOND | bits of the word before it) that are hot, and how often they occur, about."""
        order = np.argsort(pairs)
        self.hot_pairs, self.pair_pieces = pairs[order], np.maximum(-(-counts[order] // self.most), 1)
        self.pair_sums = np.zeros((4, len(pairs)))

    def hot(self, near: np.ndarray) -> np.ndarray:
        """Places of the occurrences whose context is a hot word."""
        some = np.flatnonzero(near <= BEFORE)
        return some[self.is_hot[near[some]]]

    def slice_of(self, near: np.ndarray, second: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The slice of each occurrence; second: bits of the second word."""
        key = mixed(near.astype(np.uint64))
        hot = self.hot(near)
        pair = near[hot] << SECOND | second[hot]
        key[hot] = self.word_piece(near[hot], mixed(second[hot].astype(np.uint64)) % self.pieces[near[hot]].astype(np.uint64))
        at, there = _places(self.hot_pairs, pair)
        key[hot[there]] = self.pair_piece(pair[there], mixed(symbol[hot[there]].astype(np.uint64)) % self.pair_pieces[at[there]].astype(np.uint64))
        return (key % np.uint64(self.slices)).astype(np.int64)

    @staticmethod
    def word_piece(near: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mixed(mixed(near.astype(np.uint64)) + piece.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def pair_piece(pair: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mixed(mixed(mixed(pair.astype(np.uint64))) + piece.astype(np.uint64) + np.uint64(1))

    def slices_for(self, near: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of followers of hot words: the row of each, once for each slice that may hold the pair, and that slice."""
        rows, slices = [], []
        for word in np.unique(near).tolist():
            mine = np.flatnonzero(near == word)
            pieces = np.arange(self.pieces[word])
            keys = [np.broadcast_to(self.word_piece(np.full(len(pieces), word), pieces)[:, None], (len(pieces), len(mine)))]
            for i in range(*np.searchsorted(self.hot_pairs, [word << SECOND, (word + 1) << SECOND])):
                piece = mixed(symbol[mine].astype(np.uint64)) % np.uint64(self.pair_pieces[i])
                keys.append(self.pair_piece(np.full(len(mine), self.hot_pairs[i]), piece)[None, :])
            to = np.concatenate(keys) % np.uint64(self.slices)
            rows.append(np.tile(mine, len(to)))
            slices.append(to.ravel().astype(np.int64))
        out = np.unique(np.stack([np.concatenate(slices), np.concatenate(rows)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        return out[1], out[0]

    def first(self) -> np.ndarray:
        """Probabilities of symbols without a context; 1 for the class of rare words if nothing is known."""
        out = self.count / max(self.tokens + self.kinds, 1)
        out[RARE] = (self.rare + self.kinds) / (self.tokens + self.kinds) if self.tokens else 1.0
        return out

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), RARE, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbol[at], RARE)


def vocabulary(docs: DataFrame, slice_tokens: int = SLICE_TOKENS, predicted: int = PREDICTED) -> Vocabulary:
    words = stored(count_words(docs), "words")
    end = int(END_HASH.astype(np.int64))
    tokens, kinds, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("c"))), F.lit(0))).first()
    top = words.where((F.col("c") > 0) & (F.col("word") != end)).orderBy(F.desc("c"), "word").limit(predicted).toArrow()
    return Vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy(), ends, tokens, kinds, slice_tokens)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, so that leading zeros and frequent bytes stand together."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return struct.pack("<BI", width, len(x)) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, arrays)))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        width, n = struct.unpack_from("<BI", raw, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 5).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += 5 + width * n
    return out


def contexts_of(symbols: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest context of each token, and bits of the second; starts: of texts."""
    codes = np.where(symbols == RARE, _WORD + (hashes >> np.uint64(24)).astype(np.int64), symbols)
    age = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))

    def back(n: int) -> np.ndarray:
        out = np.full(len(codes), BEFORE, np.int64)
        out[n:] = codes[: len(codes) - n]
        out[age < n] = BEFORE
        return out

    return back(1), (mixed(back(2).astype(np.uint64)) >> np.uint64(64 - SECOND)).astype(np.int64)


class Tokens:
    """Symbols and contexts of blocks of documents."""

    def __init__(self, known: Vocabulary):
        self.known, self.hashes_of = known, WordHashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts, and how many each text has."""
        hashes, bounds = self.hashes_of([t.lower() for t in texts])
        return hashes, np.diff(bounds)

    def placed(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the words of texts, each text followed by an end: hashes, which are words, symbols, and both contexts; and where texts begin."""
        n = np.append(0, np.cumsum(sizes + 1))
        hashes, inside = np.full(int(n[-1]), END_HASH), np.ones(int(n[-1]), bool)
        inside[n[1:] - 1] = False
        hashes[inside] = words
        symbols = self.known.symbols(hashes)
        symbols[n[1:] - 1] = END if self.known.ends else RARE
        return hashes, inside, symbols, *contexts_of(symbols, hashes, n[:-1]), n


def _hot_counts(docs: DataFrame, words, columns: str, keyed) -> DataFrame:
    """(key, c) summed over all documents: occurrences in training of the numbers that keyed(known, near, second, symbol) gives."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(words.value), [], 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

        def taken(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, _, symbols, near, second, _ = tokens.placed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            found = keyed(words.value, near, second, symbols)
            found, n = np.unique(found, return_counts=True)
            both, which = np.unique(np.concatenate([keys, found]), return_inverse=True)
            return both, np.bincount(which, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch, texts in blocks:
            train = in_training(batch.column("doc_id").to_pylist())
            held.append(tokens([t for t, x in zip(texts, train) if x]))
            size += len(held[-1][0])
            if size >= COUNTED:
                keys, counts = taken(keys, counts)
                held, size = [], 0
                if len(keys) > HELD_KEYS:
                    yield handed_on()
                    keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = taken(keys, counts)
        if len(keys):
            yield handed_on()

    return map_blocks(docs.select("doc_id", "text"), columns, work).groupBy("key").agg(F.sum("c").alias("c"))


def _pair_keys(known: Vocabulary, near: np.ndarray, second: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    hot = known.hot(near)
    return near[hot] << SECOND | second[hot]


def _context_keys(known: Vocabulary, near: np.ndarray, second: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hot words with their followers, and numbers of hot pairs with theirs: pairs are numbered from BEFORE + 1."""
    hot = known.hot(near)
    near, second, symbol = near[hot], second[hot], symbol[hot]
    at, there = _places(known.hot_pairs, near << SECOND | second)
    return np.concatenate([near << SYMBOL | symbol, (BEFORE + 1 + at[there]) << SYMBOL | symbol[there]])


def hot_contexts(docs: DataFrame, known: Vocabulary) -> DataFrame | None:
    """Complete known with hot pairs and the sums of hot contexts, and return (slice, followers), packets of the followers of hot words that occur KEPT times or more, with their counts, for each slice that needs them; None if no word is hot."""
    if not len(known.hot_words):
        return None
    context = docs.sparkSession.sparkContext
    share = min(1.0, PAIR_SAMPLE / known.tokens)
    pairs = _hot_counts(docs.sample(share, 23), context.broadcast(known), "key long, c long", _pair_keys).where(F.col("c") > known.most * share).toArrow()  # an eighth of a slice each, so few
    known.set_pairs(pairs.column("key").to_numpy(), np.ceil(pairs.column("c").to_numpy() / share).astype(np.int64))
    counts = stored(_hot_counts(docs, context.broadcast(known), "key long, c long", _context_keys), "hot-followers")
    kept = F.col("c") >= KEPT
    totals = counts.groupBy(F.shiftright("key", SYMBOL).alias("context")).agg(F.sum("c"), F.sum(F.when(kept, F.col("c")).otherwise(0)), F.count_if(F.col("c") == KEPT), F.count_if(F.col("c") > KEPT))
    for row in totals.collect():  # hot words and pairs, some eight for each slice
        if row[0] <= BEFORE:
            known.word_sums[:, np.searchsorted(known.hot_words, row[0])] = row[1:]
        else:
            known.pair_sums[:, row[0] - BEFORE - 1] = row[1:]
    done = context.broadcast(known)

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, c = (np.asarray(batch.column(n)) for n in ("key", "c"))
            rows, slices = done.value.slices_for(keys >> SYMBOL, keys & (1 << SYMBOL) - 1)  # by slice
            cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
            made = [(int(slices[a]), pack(keys[rows[a:b]], c[rows[a:b]])) for a, b in zip(cuts, cuts[1:]) if b > a]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], names=["slice", "followers"])

    return counts.where(kept & (F.col("key") < (BEFORE + 1) << SYMBOL)).mapInArrow(dealt, "slice long, followers binary")


def _packets(docs: DataFrame, words) -> DataFrame:
    """(slice, block, header, data): the packets of every block, and its header beside those of some slice."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        known, tokens, block = words.value, Tokens(words.value), TaskContext.get().partitionId() << 32
        base_of = np.log10(known.count + 1.0)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def sliced(keys: np.ndarray, order_by: np.ndarray, first: int, columns: list[np.ndarray], train: bytes):
            order = np.lexsort((order_by, keys))
            keys, columns = keys[order], [c[order] for c in columns]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            return [(first + int(keys[a]), block, None, pack(train, *(c[a:b] for c in columns))) for a, b in zip(cuts, cuts[1:]) if b > a]

        def rows() -> list[tuple]:
            ids = [i for part in held for i in part[0]]
            sizes = np.concatenate([part[2] for part in held])
            train = in_training(ids)
            hashes, inside, symbols, near, second, n = tokens.placed(np.concatenate([part[1] for part in held]), sizes)
            doc = np.repeat(np.arange(len(ids)), sizes + 1)
            sure = symbols != RARE
            header = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(~train), pa.array(sizes + 1), pa.array(np.add.reduceat(sure, n[:-1], dtype=np.int64)), pa.array(np.add.reduceat(np.where(sure, base_of[symbols], 0.0), n[:-1]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base"],
            )
            near_slice = known.slice_of(near, second, symbols)
            rare = np.flatnonzero(~sure & inside)
            return [
                *sliced(near_slice, near, 0, [near, second, symbols, doc], train.astype(np.uint8)),
                *sliced(hashes[rare] % np.uint64(known.rare_slices), hashes[rare], known.slices, [hashes[rare], doc[rare]], train.astype(np.uint8)),
                (int(mixed(np.array([block], np.uint64))[0] % np.uint64(known.slices)), block, _ipc(header), None),
            ]

        def emitted() -> Iterator[pa.RecordBatch]:
            made = rows()
            for a in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[a : a + 64]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["slice", "block", "header", "data"])

        for batch, texts in blocks:
            held.append((batch.column("doc_id").to_pylist(), *tokens(texts)))
            if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
                yield from emitted()
                block, held = block + 1, []
        if held:
            yield from emitted()

    return map_blocks(docs.select("doc_id", "text"), "slice long, block long, header binary, data binary", work)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _trained(packets: list[list[np.ndarray]], doc: int) -> np.ndarray:
    return np.concatenate([p[0].astype(np.float64)[p[doc].astype(np.int64)] for p in packets])


def _joined(packets: list[list[np.ndarray]], column: int) -> np.ndarray:
    return np.concatenate([p[column] for p in packets])


def _gram_steps(packets: list[list[np.ndarray]], known: Vocabulary, hot: Hot | None) -> np.ndarray:
    """Steps of every occurrence in the packets of a slice of contexts."""
    grams = Grams(*(_joined(packets, i).astype(np.int64) for i in (1, 2, 3)))
    first = known.first()
    trie = Trie.view(Trie.build(grams, _trained(packets, 4), first, hot).to_bytes())
    return trie.steps(grams, _quantised(np.maximum(first, 1e-30)).astype(np.int64))[grams.triple]


def _rare_values(packets: list[list[np.ndarray]], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every rare token: whether it is known, its part of the base score, and of the score after its class."""
    _, which = np.unique(_joined(packets, 1), return_inverse=True)
    c = np.bincount(which, _trained(packets, 2))
    share = np.where(c > 0, c, known.kinds) / max(known.rare + known.kinds, 1) if known.tokens else np.ones(len(c))
    return tuple(x[which] for x in ((c > 0).astype(np.float64), np.log10(c + 1), np.log10(share)))


ANSWER = "block long, part long, header binary, docs binary, steps binary, rare binary"


def _answers(packets: DataFrame, words, followers: DataFrame | None) -> DataFrame:
    """For each packet the sums of its documents; headers pass. followers: of hot words, by slice."""

    def work(key: tuple, table: pa.Table, hot: pa.Table | None = None) -> pa.Table:
        known, part, headers, packets = words.value, key[0].as_py(), *(table.filter(table.column(c).is_valid()) for c in ("header", "data"))
        packets, ngrams = packets.sort_by("block"), part < known.slices
        out = {"block": [*headers.column("block").to_pylist(), *packets.column("block").to_pylist()], "part": [part] * len(table)}
        out |= {"header": headers.column("header").to_pylist() + [None] * len(packets)} | {name: [None] * len(table) for name in ("docs", "steps", "rare")}
        if len(packets):
            opened = [unpack(x.as_py()) for x in packets.column("data")]
            parts = [] if hot is None else [unpack(x) for x in hot.column("followers").to_pylist()]
            told = None if hot is None else Hot(known, *(np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int64) for i in (0, 1)))
            values = (_gram_steps(opened, known, told),) if ngrams else _rare_values(opened, known)
            a = 0
            for i, packet in enumerate(opened, len(headers)):
                doc = packet[-1].astype(np.int64)
                sums = [np.bincount(doc, v[a : a + len(doc)]) for v in values]
                a += len(doc)
                docs = np.unique(doc)
                out["docs"][i] = pack(docs)
                if ngrams:
                    out["steps"][i] = pack(sums[0][docs].astype(np.int64))
                else:
                    out["rare"][i] = np.concatenate([s[docs] for s in sums]).astype("<f8").tobytes()
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    if followers is None:
        return packets.groupBy("slice").applyInArrow(lambda key, table: work(key, table), ANSWER)
    empty = pa.schema([(n, pa.int64()) for n in ("block", "part")] + [(n, pa.binary()) for n in ("header", "docs", "steps", "rare")]).empty_table()
    return packets.groupBy("slice").cogroup(followers.groupBy("slice")).applyInArrow(lambda key, table, hot: work(key, table, hot) if len(table) else empty, ANSWER)


def score(docs: DataFrame, slice_tokens: int = SLICE_TOKENS, predicted: int = PREDICTED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, token_score) of every row; token_score: score by token."""
    known = vocabulary(docs, slice_tokens, predicted)
    followers = hot_contexts(docs, known)
    words = docs.sparkSession.sparkContext.broadcast(known)
    tokens, seen = words.value.tokens, float(np.log10(words.value.tokens + words.value.kinds + 1))

    def work(table: pa.Table) -> pa.Table:
        header = next(h for h in table.column("header").to_pylist() if h is not None)
        head = pa.ipc.open_stream(header).read_all()
        n = head.num_rows
        steps, known, base, rare = np.zeros(n, np.int64), head.column("n_known").to_numpy().copy(), head.column("base").to_numpy().copy(), np.zeros(n)
        for row in sorted(table.drop_columns(["header"]).to_pylist(), key=lambda r: r["part"]):
            if row["docs"] is None:
                continue
            at = unpack(row["docs"])[0].astype(np.int64)
            if row["steps"] is not None:
                steps[at] += unpack(row["steps"])[0].astype(np.int64)
            else:
                k, b, v = np.frombuffer(row["rare"], "<f8").reshape(3, -1)
                known[at] += k.astype(np.int64)
                base[at] += b
                rare[at] += v
        sizes = head.column("n_tokens").to_numpy()
        score = rare - steps / STEPS
        return pa.table([head.column("doc_id"), head.column("held_out"), sizes, known, np.full(n, tokens), base - sizes * seen, score, score / sizes], names=RESULT)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, token_score double"
    return _answers(_packets(docs, words), words, followers).groupBy("block").applyInArrow(work, schema)


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "token_score"]
