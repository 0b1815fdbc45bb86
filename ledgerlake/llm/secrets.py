"""Secret scans: a keyword automaton, anchored patterns at its hits, then checksums inside the found texts.

An Aho-Corasick automaton over all keywords reads a block of texts once, in lower
case (A-Z). A pattern is tried only where a keyword of its kind begins, anchored there; a
kind's matches are taken from left to right and do not overlap, and a match that is
too short still uses up its place, as in one search over the whole text. Runs of hex digits
hold no keyword: they are the runs of one class of bytes. Kinds with a checksum (base-62
CRC-32, Base58Check, ISO 7064 modulo 97, Luhn) count only where it holds.

Null and empty texts have no spans. Texts are read whole, however long; rows are judged
one by one, so ties, repeated rows and null doc_ids need no rule. Positions are code points. Other
columns pass through; the new ones get underscores where names clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_blocks

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62."""
    body, number = token[token.index("_") + 1 : -6], 0
    for c in token[-6:]:
        number = number * 62 + BASE62.index(c)
    return number == zlib.crc32(body.encode())


def base58_holds(key: str) -> bool:
    """78 bytes and the first four of their double SHA-256."""
    number = 0
    for c in key:
        number = number * 58 + BASE58.index(c)
    if number >> 656:
        return False
    data = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def iban_holds(number: str) -> bool:
    plain = number.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def luhn_holds(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(d // 5 + 2 * d % 10 for d in digits[1::2])) % 10 == 0 and any(digits)


@dataclass(frozen=True)
class Kind:
    """pattern is tried where a keyword begins; a match counts if ``holds`` is true of its group."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    group: int = 0
    least: int = 0
    holds: Callable[[str], bool] | None = None
    base: bool = False


#: The base kinds but for hex runs, then those with a checksum. Keywords are in lower case.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", holds=crc_holds),
    Kind("npm", ("npm_",), r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", holds=crc_holds),
    Kind("xprv", ("xprv",), r"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])", holds=base58_holds),
    Kind("iban", ("iban",), r"(?<![A-Za-z0-9])(?ai:iban)\x20*[:=]?\x20*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 1, holds=iban_holds),
    Kind("card", ("card",), r"(?<![A-Za-z0-9])(?ai:card(?:\x20(?:number|no))?)\x20*[:=]?\x20*([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", 1, holds=luhn_holds),
)
#: Least length of a run of hex digits, and the place of its kind among the others.
HEX_LEAST, HEX_AT = 32, 2
NAMES = tuple(k.name for k in KINDS[:HEX_AT]) + ("hex",) + tuple(k.name for k in KINDS[HEX_AT:])
BASE = ("assign", "access", "hex")

_hex = np.zeros(256, bool)
_hex[list(b"0123456789abcdef")] = True


class Scanner:
    """Spans (start, place of the kind in NAMES, end) of blocks of texts, by code points."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = [(NAMES.index(k.name), k, re.compile(k.pattern)) for k in kinds]
        by_word = defaultdict(list)
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                by_word[word].append(i)
        self.words = ahocorasick.Automaton()
        for word, of in by_word.items():
            self.words.add_word(word, (len(word), of))
        self.words.make_automaton()

    def __call__(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        joined = b"\0".join(texts)
        text = joined.decode("utf-8", "replace")
        starts = np.cumsum([0, *(len(t.decode("utf-8", "replace")) + 1 for t in texts[:-1])]).tolist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, kind, end in self._keyword_spans(text, joined.lower().decode("utf-8", "replace")):
            row = bisect_right(starts, start) - 1
            found[row].append((start - starts[row], kind, end - starts[row]))
        for row, start, end in _hex_runs(texts):
            found[row].append((start, HEX_AT, end))
        return [sorted(x) for x in found]

    def _keyword_spans(self, text: str, lowered: str) -> Iterator[tuple[int, int, int]]:
        hits: dict[int, list[int]] = defaultdict(list)
        for last, (length, of) in self.words.iter(lowered):
            for i in of:
                hits[i].append(last + 1 - length)
        for i, begins in hits.items():
            (place, kind, pattern), free = self.kinds[i], 0
            for at in sorted(begins):
                if at >= free and (match := pattern.match(text, at)):
                    free, value = match.end(), match[kind.group]
                    if len(value) >= kind.least and (kind.holds is None or kind.holds(value)):
                        yield at, place, free


def _hex_runs(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the long runs of hex digits."""
    for row, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(_hex[data].view(np.int8), prepend=0, append=0))
        long = np.flatnonzero(edges[1::2] - edges[::2] >= HEX_LEAST)
        for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist()):
            start = len(text[:a].decode("utf-8", "replace"))
            yield row, start, start + b - a


SPAN = "struct<kind:string,start:bigint,stop:bigint>"


def scan(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) and ``spans``, an array of (kind, start, stop), by start and then by kind as in NAMES."""
    columns = docs.columns if columns is None else columns
    name = free_name(columns, "spans")
    kind_of = pa.array(NAMES)

    def work(blocks) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch, texts in blocks:
            rows = scanner(texts)
            flat = np.array([s for row in rows for s in row], np.int64).reshape(-1, 3)
            offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            spans = pa.StructArray.from_arrays([kind_of.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], names=["kind", "start", "stop"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(offsets, spans)], names=[*columns, name])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return map_blocks(docs.select(*dict.fromkeys([*columns, "text"])), ", ".join([*kinds, f"`{name}` array<{SPAN}>"]), work)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret of text replaced by its kind in brackets; of spans that overlap the first counts, and takes in the others."""
    columns = docs.columns
    found = scan(docs)
    spans = found.columns[-1]

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            out = []
            for text, row in zip(texts, batch.column(spans).to_pylist()):
                if not row:
                    out.append(text)
                    continue
                whole, parts, at = text.decode("utf-8", "replace"), [], 0
                for i, s in enumerate(row):
                    if s["start"] >= at:
                        stop = s["stop"]
                        for later in row[i + 1 :]:
                            if later["start"] >= stop:
                                break
                            stop = max(stop, later["stop"])
                        parts += [whole[at : s["start"]], f"[{s['kind']}]"]
                        at = stop
                out.append("".join([*parts, whole[at:]]).encode())
            texts_ = pa.array(out, pa.binary(), mask=np.asarray(batch.column("text").is_null())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts_ if c == "text" else batch.column(c) for c in columns], names=columns)

    return map_blocks(found, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), work)


def written(spans: str, kinds: tuple[str, ...] | None = None) -> F.Column:
    """Spans (of some kinds) as kind:start:stop, joined by commas."""
    some = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
