"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code-point classes. Where a token starts depends on the
classes beside it and on one thing that runs from left to right: the letters that a
contraction still has to take. That automaton has four states, so a character is a
function of states in one byte; functions are composed by a table, which is
associative, and a scan over strips of characters gives the state everywhere,
without a regular expression. The slices between starts feed pair merging, whose
results are cached. Byte offsets of every ``STEP``-th id are kept, so that a part of a
text can be decoded alone.

Null and empty texts have no ids. Rows are encoded one by one and whole, however long;
ties, repeated rows and null doc_ids need no rule. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PieceCache, map_blocks

#: Ids between kept byte offsets.
STEP = 256
OTHER, LETTER, NUMBER, SPACE = range(4)
# The characters of the Unicode property White_Space, as a pattern's \s takes them.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers of Unicode 16, which older tables of Python lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# Symbols of the automaton.
_OTHER, _LETTER, _NUMBER, _ONE, _TWO, _GAP, _LAST_BLANK, _LAST_GAP, _STOP = range(9)
# States: nothing pending, one letter of a contraction pending, two, contraction just over.
_REST, _PENDING1, _PENDING2, _OVER = range(4)


def _function(*to: int) -> int:
    return sum(t << 2 * s for s, t in enumerate(to))


_ALWAYS = [_function(t, t, t, t) for t in range(4)]
_FUNCTIONS = np.array([_ALWAYS[_REST], _function(_REST, _OVER, _PENDING1, _REST), _ALWAYS[_REST], _ALWAYS[_PENDING1], _ALWAYS[_PENDING2], *[_ALWAYS[_REST]] * 4], np.uint8)
_IDENTITY = _function(0, 1, 2, 3)


def _composition() -> np.ndarray:
    """At 256 * f + g: f, then g."""
    f, g = np.divmod(np.arange(65536), 256)
    return sum(((g >> 2 * ((f >> 2 * s) & 3)) & 3) << 2 * s for s in range(4)).astype(np.uint8)


_THEN = _composition()


def states(functions: np.ndarray, strip: int = 128) -> np.ndarray:
    """State after each character, by composing functions within strips, then across them."""
    n = len(functions)
    if n <= strip:
        out, s = np.zeros(n, np.uint8), 0
        for i, f in enumerate(functions.tolist()):
            out[i] = s = f >> 2 * s & 3
        return out
    padded = np.full(-(-n // strip) * strip, _IDENTITY, np.uint8)
    padded[:n] = functions
    lanes = np.ascontiguousarray(padded.reshape(-1, strip).T)
    for j in range(1, strip):
        lanes[j] = _THEN[lanes[j - 1].astype(np.uint16) << 8 | lanes[j]]
    first = np.zeros(lanes.shape[1], np.uint8)
    first[1:] = states(lanes[-1], strip)[:-1]
    return ((lanes >> 2 * first) & 3).T.ravel()[:n]


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    table[[k == "L" for k in kinds]] = LETTER
    table[[k == "N" for k in kinds]] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE_SPACE] = SPACE
    return table


class Splitter:
    """Byte offsets at which the pre-tokens of a block of texts start."""

    def __init__(self):
        self.table = classes()

    def __call__(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The joined texts, the offsets of all pre-tokens and stops, and the places of the stops in them."""
        raw = b"\0".join([*texts, b""])
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        offsets = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
        stops = np.searchsorted(offsets, np.cumsum([len(t) + 1 for t in texts]) - 1)
        kind = self.table[points]
        symbols = np.array([_OTHER, _LETTER, _NUMBER, _GAP], np.uint8)[kind]
        symbols[stops] = _STOP
        dense = np.append(symbols, _STOP)
        gap = symbols == _GAP
        last = gap & (dense[1:] != _GAP) & (dense[1:] != _STOP)
        symbols[last] = _LAST_GAP
        symbols[last & (points == 0x20)] = _LAST_BLANK
        self._contractions(points, symbols)
        before = np.zeros(len(symbols), np.uint8)
        before[1:] = states(_FUNCTIONS[symbols])[:-1]
        previous = np.full(len(symbols), _STOP, np.uint8)
        previous[1:] = symbols[:-1]
        joins = (symbols == previous) & ((symbols <= _NUMBER) | (symbols == _GAP)) & (before == _REST)
        joins |= (previous == _LAST_BLANK) & (symbols <= _NUMBER)
        joins |= (before == _PENDING1) | (before == _PENDING2)
        starts = np.flatnonzero(~joins)
        return raw, offsets[starts], np.searchsorted(starts, stops)

    @staticmethod
    def _contractions(points: np.ndarray, symbols: np.ndarray) -> None:
        at = np.flatnonzero(points == 0x27)
        at = at[symbols[at] == _OTHER]
        before = np.where(at > 0, symbols[at - 1], _STOP)
        at = at[(before != _OTHER) & (before != _LAST_BLANK)]
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        # The contractions of the pattern, 's 't 'm 'd and 're 've 'll.
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = _ONE
        pair = one.astype(np.int64) << 32 | two
        symbols[at[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = _TWO


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: base64 of the bytes and the rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of least rank (leftmost of equals) is merged until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # by start: end of the part there, start of the part before

    def pair(a: int) -> tuple[int, int, int] | None:
        b = end[a]
        if b < n and (r := ranks.get(piece[a : end[b]])) is not None:
            return r, a, end[b]
        return None

    heap = [p for a in range(n - 1) if (p := pair(a))]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, a, c = heapq.heappop(heap)
        b = end[a] if alive[a] else n
        if b >= n or end[b] != c:
            continue  # one of its parts has grown meanwhile
        end[a], alive[b] = c, False
        if c < n:
            left[c] = a
        for x in (left[a], a):
            if x >= 0 and (p := pair(x)):
                heapq.heappush(heap, p)
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker runs, so that its cache stays warm."""
    return Encoder(path)


@cache
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, path: str):
        self.ranks, self.split = ranks_of(path), Splitter()
        self.cache = PieceCache(lambda p: array("I", merged(p, self.ranks)).tobytes())

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        raw, offsets, stops = self.split(texts)
        known, out, a = self.cache.lookup(), [], 0
        for b in stops.tolist():
            cuts = offsets[a : b + 1].tolist()
            out.append(b"".join([known(raw[x:y]) for x, y in zip(cuts, cuts[1:])]))
            a = b + 1
        return out


class Vocabulary:
    """Bytes of ids, for decoding."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, array("I", ids)))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of every STEP-th id, and of the end."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])])
        return np.append(ends[:-1:STEP], ends[-1])

    def decode_part(self, ids: bytes, offsets: np.ndarray, start: int, stop: int) -> bytes:
        """Bytes start to before stop of the text, from the ids between the kept offsets around them."""
        a = max(0, int(np.searchsorted(offsets[:-1], start, side="right")) - 1)
        b = int(np.searchsorted(offsets[:-1], stop, side="left"))
        part = self.decode(ids[4 * STEP * a : 4 * STEP * b])
        first = int(offsets[a]) if len(offsets) else 0
        return part[start - first : stop - first]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets) of every text."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = encoder_of(path), vocabulary_of(path)
        for batch, texts in blocks:
            ids = encoder(texts)
            offsets = pa.array([vocabulary.offsets(x) for x in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), offsets], names=["doc_id", "ids", "offsets"])

    return map_blocks(docs.select("doc_id", "text"), "doc_id long, ids binary, offsets array<bigint>", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, decimals, decoded): the ids as decimals joined by commas, and the bytes they stand for."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        digits = [str(i).encode() for i in range(len(vocabulary.bytes))]
        for batch, all_ids in blocks:
            decimals = [b",".join(map(digits.__getitem__, array("I", x))) for x in all_ids]
            decoded = [vocabulary.decode(x) for x in all_ids]
            sizes = pa.array([len(x) // 4 for x in all_ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(decimals, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "decimals", "decoded"])

    return map_blocks(encoded.select("doc_id", "ids"), "doc_id long, n_tokens long, decimals binary, decoded binary", work, "ids")
