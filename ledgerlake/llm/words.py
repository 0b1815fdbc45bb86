"""Word sequences as arrays: hashes of words and of runs of words."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash


class WordHashes:
    """64-bit hashes of the words (runs between ASCII white space) of blocks of texts."""

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and the bounds of each text's words in them."""
        words = [t.split() for t in texts]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=bounds[1:])
        return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(bounds[-1])), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Hashes of all runs of ``length`` consecutive words, by a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (self.base, self.inverse))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a to before b."""
        return mixed((sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64))

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((sums[length:] - sums[:n]) * self.inverses[:n] + np.uint64(length))


def inside(bounds: np.ndarray, length: int, total: int) -> np.ndarray:
    """For each of the runs that start at 0.. of total words: whether it stays in one text."""
    ok = np.ones(max(0, total - length + 1), bool)
    ends = bounds[1:-1]
    for back in range(1, length):
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
