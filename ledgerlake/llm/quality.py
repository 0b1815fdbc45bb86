"""Quality rules: a short-circuit cascade, ordered by rejection per cost.

Each rule is a measure of a document and a limit. On a bounded sample every rule
is timed alone and its rejections are counted; the rules then run in the order
of rejected documents per second, and a document that one rule rejects is not
seen by the later ones. The order changes the cost only: a document is kept if
no rule rejects it.

Null and empty texts have no words and so fail the length rule. Rows are judged
one by one and whole, however long, so ties, repeated rows and null doc_ids need no rule of
their own. An empty table gives no rows.
Other columns pass through; verdict columns get underscores where names clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_blocks
from .words import Runs, WordHashes, inside, mixed

#: Rows, about, of the sample on which costs and rejections are estimated; sets the order of the rules, never a verdict.
SAMPLE_ROWS = 2000
#: Words in a window that may repeat.
WINDOW = 5

_symbols, _spaces, _starts, _capitals, _letters = (np.zeros(256, bool) for _ in range(5))
_symbols[list(b"#*$%&|<>")] = True
_spaces[list(b" \t\n\x0b\x0c\r")] = True
_starts[[b for b in range(256) if b & 0xC0 != 0x80]] = True
_capitals[0x41:0x5B] = True
_letters[0x41:0x5B] = _letters[0x61:0x7B] = True


class Block:
    """Measures of a block of texts, made for the texts that ask and kept."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, runs: Runs):
        self.texts, self.hashes, self.runs = texts, hashes, runs
        self.have: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        values, known = self.have.setdefault(name, (np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)))
        if len(new := rows[~known[rows]]):
            values[new] = MEASURES[name](self, [self.texts[i] for i in new], new)
            known[new] = True
        return values[rows]

    def bytes_in(self, texts: list[bytes], kind: np.ndarray) -> np.ndarray:
        """How many bytes of each text are of a kind."""
        ends = np.cumsum([len(t) for t in texts])
        counts = np.concatenate([[0], np.cumsum(kind[np.frombuffer(b"".join(texts), np.uint8)], dtype=np.int64)])
        return np.diff(counts[ends], prepend=0)


def _words(b: Block, texts: list[bytes], rows: np.ndarray) -> list[int]:
    return [len(t.split()) for t in texts]


def _word_chars(b: Block, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    return b.bytes_in(texts, _starts & ~_spaces)


def _symbols_in(b: Block, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    return b.bytes_in(texts, _symbols)


def _capitals_in(b: Block, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    return b.bytes_in(texts, _capitals)


def _letters_in(b: Block, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    return b.bytes_in(texts, _letters)


def _full_lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def _lines(b: Block, texts: list[bytes], rows: np.ndarray) -> list[int]:
    return [len(_full_lines(t)) for t in texts]


def _dup_lines(b: Block, texts: list[bytes], rows: np.ndarray) -> list[int]:
    return [len(x := _full_lines(t)) - len(set(x)) for t in texts]


def _repeat_words(b: Block, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
    hashes, bounds = b.hashes(texts)
    ok = np.flatnonzero(inside(bounds, WINDOW, len(hashes)))
    owner = np.searchsorted(bounds, ok, side="right").astype(np.uint64)
    keys = b.runs.all(b.runs.sums(hashes), WINDOW)[ok] ^ mixed(owner)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(hashes), np.int64)
    found[ok[order[1:][same]]] = 1
    found[ok[order[:-1][same]]] = 1
    counts = np.cumsum(found)
    covered = counts.copy()
    covered[WINDOW:] -= counts[:-WINDOW]
    total = np.concatenate([[0], np.cumsum(covered > 0)])
    return np.diff(total[bounds])


MEASURES: dict[str, Callable] = {
    "n_words": _words, "word_chars": _word_chars, "n_symbols": _symbols_in, "n_capitals": _capitals_in, "n_letters": _letters_in,
    "n_lines": _lines, "n_dup_lines": _dup_lines, "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where fails(measures in order) is true."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[..., np.ndarray]
    base: bool = False


RULES = (
    Rule("too few words", ("n_words",), lambda n: n < 10, base=True),
    Rule("repeated windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n, base=True),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 4 * s > n),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 5 * n),
    Rule("word length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 40 * n)),
    Rule("capitals", ("n_capitals", "n_letters"), lambda c, n: (n >= 50) & (10 * c > 6 * n)),
)


def _rejected(rule: Rule, block: Block, rows: np.ndarray) -> np.ndarray:
    return rule.fails(*(block.get(m, rows) for m in rule.measures))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds a document and rejected share of each rule, on a sample of about ``rows`` rows from all parts of docs."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        hashes, runs = WordHashes(), Runs(0x5851F42D4C957F2D)
        spent, hit, seen = [0.0] * len(rules), [0] * len(rules), 0
        for _, texts in blocks:
            everything, seen = np.arange(len(texts)), seen + len(texts)
            for i, rule in enumerate(rules):
                block, began = Block(texts, hashes, runs), time.perf_counter()
                hit[i] += int(_rejected(rule, block, everything).sum())
                spent[i] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules))), pa.array(spent), pa.array(hit), pa.array([seen] * len(rules))], names=["rule", "s", "hit", "seen"])

    sample = docs.select("text").sample(min(1.0, rows / max(docs.count(), 1)), 7)
    found = map_blocks(sample, "rule long, s double, hit long, seen long", work).groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hit").alias("hit"), F.sum("seen").alias("seen")).collect()
    return {rules[r.rule].name: (r.s / r.seen, r.hit / r.seen) for r in found}  # a row for each rule


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Most rejections per cost first; rules without an estimate keep their place at the end."""
    worth = {name: share / max(cost, 1e-9) for name, (cost, share) in estimates.items()}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, -1.0)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default), the measures asked for, base_failed and kept.

    rules run in the order given. base_failed is null where another rule had
    rejected the row already, unless the measures of the base rules are asked for.
    """
    columns = docs.columns if columns is None else columns
    names = [free_name(columns, x) for x in (*measures, "base_failed", "kept")]
    inputs = list(dict.fromkeys([*columns, "text"]))

    def work(blocks) -> Iterator[pa.RecordBatch]:
        hashes, runs = WordHashes(), Runs(0x5851F42D4C957F2D)
        for batch, texts in blocks:
            block = Block(texts, hashes, runs)
            everything = alive = np.arange(len(texts))
            shown = [block.get(m, everything) for m in measures]
            base, known = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
            kept = np.ones(len(texts), bool)
            for rule in rules:
                rows = everything if rule.base and set(rule.measures) <= set(measures) else alive
                failed = _rejected(rule, block, rows)
                kept[rows[failed]] = False
                if rule.base:
                    base[rows[failed]] = True
                    known[rows] += 1
                alive = np.flatnonzero(kept)
            settled = base | (known == sum(r.base for r in rules))
            new = [*map(pa.array, shown), pa.array(base, mask=~settled), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=[*columns, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = [f"`{c}` {kinds[c]}" for c in columns] + [f"`{n}` bigint" for n in names[:-2]] + [f"`{n}` boolean" for n in names[-2:]]
    return map_blocks(docs.select(*inputs), ", ".join(schema), work)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    judged = judge(docs, ordered(rules, estimate(docs, rules)))
    return judged.where(judged.columns[-1]).select(*docs.columns)
