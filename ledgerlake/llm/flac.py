"""Media columns: FLAC streams decoded to PCM blocks with seekable sample offsets.

``decode`` reads a binary column of FLAC streams (mono, 8 bits): it verifies the CRC-8
of every frame header, the CRC-16 of every frame and the MD5 of the samples, decodes
Rice residuals and undoes the linear predictors. All frames of a block of rows are
decoded in step, one sample of each at a time, so that numpy works across frames;
a seek table gives their places. Streams without one, and codes that are rare
(escapes, several Rice partitions, LPC subframes, codewords over 16 bits), take a
plain bit reader. ``encode`` stores bytes as samples: fixed predictors of order 0 to
2, one Rice parameter a frame, a seek point a frame.

``pcm_blocks`` writes the samples as blocks, a row for each frame with the first
sample's offset, and ``samples_at`` reads stretches of samples from the blocks that hold
them, so that a part of a long stream is read alone.

A broken stream is reported in ``error`` and has null samples and no blocks; the others
are not harmed. Null and empty texts are 64 zero bytes. Equal texts give equal streams;
repeated rows are coded each, null doc_ids pass. Texts of any length are coded whole, a
long one as a block of rows of its own. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_blocks

FRAME = 1024
RATE = 8000
#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Codewords up to this many bits are decoded by table.
WINDOW = 16
#: Fixed predictors: weights of the samples before.
PREDICTORS = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = (table << 1 ^ np.where(table >> (bits - 1) & 1, polynomial, 0).astype(np.uint32)) & np.uint32((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of data, all stretches in step."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    crc = np.zeros(len(at), np.uint16)
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left").tolist()
    for i, n in enumerate(live):
        now = crc[:n]
        crc[:n] = now << np.uint16(8) ^ _CRC16[(now >> np.uint16(8)) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@cache
def frame_header(number: int, size: int) -> bytes:
    """Header of a mono 8-bit frame of fixed block size, with its CRC-8."""
    code, tail = (0b1010, b"") if size == FRAME else (0b0111, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0010]) + chr_utf8(number) + tail
    return head + bytes([crc8(head)])


def chr_utf8(n: int) -> bytes:
    """n coded as UTF-8 codes characters, up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 6) if n < 1 << 5 * k + 6)
    lead = (0xFF << 7 - more & 0xFF | n >> 6 * more) & 0xFF
    return bytes([lead, *(0x80 | n >> 6 * k & 0x3F for k in reversed(range(more)))])


def payload(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload of 1 byte or more; sample = byte - 128."""
    counts = np.array([-(-len(p) // FRAME) for p in payloads])
    sizes = np.full(int(counts.sum()), FRAME)
    ends = np.cumsum(counts)
    sizes[ends - 1] = [len(p) - (c - 1) * FRAME for p, c in zip(payloads, counts.tolist())]
    numbers = np.arange(len(sizes)) - np.repeat(ends - counts, counts)
    inside = np.arange(FRAME) < sizes[:, None]
    samples = np.zeros((len(sizes), FRAME), np.int32)
    samples[inside] = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    order, k, folded = _coded(samples, inside, sizes)
    parts = _subframes(samples, inside, sizes, order, k, folded)
    heads = [frame_header(n, s) for n, s in zip(numbers.tolist(), sizes.tolist())]
    frames = np.frombuffer(b"".join([x for h, p in zip(heads, parts) for x in (h, p)]), np.uint8)
    lengths = np.array([len(h) + len(p) for h, p in zip(heads, parts)])
    starts = np.cumsum(lengths) - lengths
    crcs = crc16(frames, starts, lengths).astype(">u2").tobytes()
    body = frames.tobytes()
    whole = [body[a : a + n] + crcs[2 * i : 2 * i + 2] for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist()))]
    out, a = [], 0
    for data, b in zip(payloads, ends.tolist()):
        own = whole[a:b]
        md5 = hashlib.md5(np.bitwise_xor(np.frombuffer(data, np.uint8), 128).tobytes(), usedforsecurity=False).digest()
        small, large = min(map(len, own)), max(map(len, own))
        fields = RATE << 44 | (8 - 1) << 36 | len(data)  # rate (20 bits), channels - 1 (3), bits - 1 (5), samples (36)
        info = struct.pack(">HH", FRAME, FRAME) + small.to_bytes(3) + large.to_bytes(3) + struct.pack(">Q", fields) + md5
        offsets = np.cumsum([0, *map(len, own)]).tolist()
        seek = b"".join(struct.pack(">QQH", i * FRAME, offsets[i], sizes[a + i]) for i in range(b - a))
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3), info, b"\x83", len(seek).to_bytes(3), seek, *own]))
        a = b
    return out


def _coded(samples: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictor order, Rice parameter, and zig-zag residuals of each frame: those of fewest bits."""
    best = np.full(len(sizes), np.iinfo(np.int64).max)
    order, k, folded = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(samples.shape, np.int32)
    residual = samples
    for o in range(3):
        if o:
            residual = np.diff(residual, axis=1)
        valid = inside[:, o:]
        zigzag = np.where(valid, residual << 1 ^ residual >> 31, 0)
        for p in range(3, 8):
            q = zigzag >> p
            bits = np.where(q.max(axis=1) + 1 + p <= WINDOW, q.sum(axis=1) + (sizes - o) * (p + 1) + 8 * o, np.iinfo(np.int64).max)
            better = np.flatnonzero((bits < best) & (sizes > o))
            best[better], order[better], k[better] = bits[better], o, p
        rows = np.flatnonzero(order == o) if o else slice(None)
        folded[rows, o:] = zigzag[rows]
    return order, k, folded


def _subframes(samples: np.ndarray, inside: np.ndarray, sizes: np.ndarray, order: np.ndarray, k: np.ndarray, folded: np.ndarray) -> list[bytes]:
    coded = inside & (np.arange(FRAME) >= order[:, None])
    frame, _ = np.nonzero(coded)
    value, kk = folded[coded], k[frame]
    length = (value >> kk) + 1 + kk
    total = np.bincount(frame, length, len(sizes)).astype(np.int64)
    width = -(-(8 + 8 * order + 10 + total) // 8)  # bytes: subframe header, warm-up, method and partitions and parameter, codewords
    first = 8 * (np.cumsum(width) - width)
    bits = np.zeros(8 * int(width.sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray, n: int) -> None:
        for j in range(n):
            bits[at + n - 1 - j] = values >> j & 1

    put(first, 0b00010000 | order << 1, 8)
    for o in (0, 1):
        rows = np.flatnonzero(order > o)
        put(first[rows] + 8 + 8 * o, samples[rows, o] & 0xFF, 8)
    put(first + 8 + 8 * order + 6, k, 4)
    run = np.cumsum(length)
    end = run - (run[np.cumsum(coded.sum(axis=1)) - 1] - total)[frame] + (first + 18 + 8 * order)[frame]
    word = value & (1 << kk) - 1 | 1 << kk
    for j in range(8):
        at = end[word >> j & 1 == 1]
        bits[at - 1 - j] = 1
    packed = np.packbits(bits).tobytes()
    return [packed[a : a + w] for a, w in zip((first // 8).tolist(), width.tolist())]


class Bits:
    """A plain reader of single fields."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        self.at = b
        value = int.from_bytes(self.data[a >> 3 : (b + 7) >> 3])
        return value >> (-b & 7) & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> n - 1 else value

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _plain_residuals(bits: Bits, size: int, order: int) -> list[int]:
    method, partitions = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % partitions:
        raise ValueError("residual coding")
    width, out = 4 + method, []
    for p in range(partitions):
        n = size // partitions - (order if p == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                value = bits.zeros() << k | (bits.take(k) if k else 0)
                out.append(value >> 1 ^ -(value & 1))
    return out


def plain_subframe(data: bytes, at: int, size: int, width: int = 8) -> tuple[list[int], int]:
    """Samples of one subframe of any kind, and the byte after it."""
    bits = Bits(data, 8 * at)
    if bits.take(1):
        raise ValueError("subframe header")
    kind, wasted = bits.take(6), bits.take(1)
    if wasted:
        wasted += bits.zeros()
        width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        weights, shift = PREDICTORS[order] if kind < 32 else [], 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _plain_residuals(bits, size, order):
            out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("subframe kind")
    return [x << wasted for x in out], -(-bits.at // 8)


@cache
def parse_header(head: bytes) -> tuple[int, int, int]:
    """(header bytes, frame number, block size) at the start of head, once its CRC-8 is verified."""
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] >> 4 or head[3] >> 1 & 7 not in (0, 1):
        raise ValueError("frame header")
    lead = head[4]
    more = max(0, (8 - (~lead & 0xFF).bit_length()) - 1)
    number = lead & (0x7F >> more + (more > 0)) if more else lead
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    at, code, rate = 5 + more, head[2] >> 4, head[2] & 15
    if code in (6, 7):
        size = int.from_bytes(head[at : at + code - 5]) + 1
        at += code - 5
    else:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    at += (rate in (12, 13, 14)) + (rate in (13, 14))
    if not code or crc8(head[:at]) != head[at]:
        raise ValueError("frame header CRC-8")
    return at + 1, number, size


def _metadata(data: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, MD5, seek points and the byte at which frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, n = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        block, at = data[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            fields = int.from_bytes(block[10:18])
            total, md5 = fields & (1 << 36) - 1, block[18:34]
            if fields >> 41 & 7 or (fields >> 36 & 31) != 7:
                raise ValueError("only mono streams of 8 bits")
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
    return total, md5, points, at


@cache
def _codes(k: int) -> np.ndarray:
    """For the next WINDOW bits: residual << 5 | bits of the codeword, or 0 if it is longer."""
    bits = np.arange(1 << WINDOW)
    zeros = WINDOW - np.array([int(b).bit_length() for b in range(1 << WINDOW)])
    length = zeros + 1 + k
    value = zeros << k | bits >> np.maximum(WINDOW - length, 0) & (1 << k) - 1
    return np.where((length <= WINDOW) & (bits > 0), (value >> 1 ^ -(value & 1)) << 5 | length, 0).astype(np.int32)


def _rice(data: np.ndarray, at: np.ndarray, k: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of each frame from bit at on, in step; the bit after each, and which met a longer codeword."""
    tables = np.stack([_codes(p) for p in range(8)]).ravel()
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]  # 24 bits from each byte on
    out = np.zeros((int(counts.max(initial=0)), len(at)), np.int32)
    order = np.argsort(-counts, kind="stable")
    pos, table, bad = at[order], (k[order] << WINDOW), np.zeros(len(at), bool)
    live = np.searchsorted(-counts[order], -np.arange(len(out)), side="left").tolist()
    for i, n in enumerate(live):
        p = pos[:n]
        code = tables[table[:n] + (words[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF)]
        out[i, :n] = code >> 5
        step = code & 31
        if not step.all():
            bad[:n] |= step == 0
        pos[:n] = np.minimum(p + step, 8 * len(data))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return np.ascontiguousarray(out.T)[back], pos[back], bad[back]


def decode_streams(streams: list[bytes | None]) -> tuple[list[bytes | None], list[list[int]], list[str | None]]:
    """Samples (signed bytes), first samples of the blocks, and what is wrong, of each stream."""
    frames, meta, errors = [], [], [None] * len(streams)
    for i, data in enumerate(streams):
        try:
            total, md5, points, begin = _metadata(data or b"")
            own = [(i, begin + p[1], p[0]) for p in points]
            if sum(p[2] for p in points) != total:
                own = list(_walk(i, data, begin))
            ends = [*(f[1] for f in own[1:]), len(data)]
            for (_, a, _), b in zip(own, ends):
                frames.append((i, a, b, *parse_header(data[a : a + 16][: _header_size(data, a)])))
            meta.append((total, md5, [f[2] for f in own]))
        except (ValueError, IndexError, struct.error) as e:
            meta.append((0, b"", []))
            frames = [f for f in frames if f[0] != i]
            errors[i] = f"{e}" or type(e).__name__
    samples = _decode_frames(streams, frames, errors)
    out: list[bytes | None] = []
    by_stream: dict[int, list[bytes]] = {}
    for f, s in zip(frames, samples):
        by_stream.setdefault(f[0], []).append(s)
    for i, (total, md5, _) in enumerate(meta):
        pcm = b"".join(by_stream.get(i, []))
        if errors[i] is None and len(pcm) != total:
            errors[i] = "samples missing"
        if errors[i] is None and md5.strip(b"\0") and hashlib.md5(pcm, usedforsecurity=False).digest() != md5:
            errors[i] = "MD5 of the samples"
        out.append(None if errors[i] else pcm)
    return out, [[] if e else m[2] for m, e in zip(meta, errors)], errors


def _header_size(data: bytes, a: int) -> int:
    """Bytes of the frame header at a."""
    more = max(0, (8 - (~data[a + 4] & 0xFF).bit_length()) - 1)
    code, rate = data[a + 2] >> 4, data[a + 2] & 15
    return 6 + more + (code in (6, 7)) + (code == 7) + (rate in (12, 13, 14)) + (rate in (13, 14))


def _walk(i: int, data: bytes, at: int) -> Iterator[tuple[int, int, int]]:
    """Frames of a stream without a full seek table: each is read to find the next."""
    first = 0
    while at < len(data):
        head, _, size = parse_header(data[at : at + 16][: _header_size(data, at)])
        yield i, at, first
        _, end = plain_subframe(data, at + head, size)
        at, first = end + 2, first + size


def _decode_frames(streams: list[bytes | None], frames: list[tuple], errors: list[str | None]) -> list[bytes]:
    if not frames:
        return []
    stream, a, b, head, _, size = (np.array(x) for x in zip(*frames))
    joined = b"".join(x or b"" for x in streams)
    shift = np.cumsum([0, *(len(x or b"") for x in streams)])[stream]
    data, a, b = np.frombuffer(joined, np.uint8), a + shift, b + shift
    stored = data[b - 2].astype(np.uint16) << np.uint16(8) | data[b - 1]
    for f in np.flatnonzero(crc16(data, a, b - a - 2) != stored):
        errors[stream[f]] = "frame CRC-16"
    kind, order = data[a + head], (data[a + head] >> 1).astype(np.int64) - 8
    simple = (kind >> 7 == 0) & (kind & 1 == 0) & (order >= 0) & (order <= 2) & (size > order)
    at = 8 * (a + head + 1 + np.where(simple, order, 0))
    last = len(data) - 1
    lead = data[np.minimum(at >> 3, last)].astype(np.int64) << 8 | data[np.minimum((at >> 3) + 1, last)]
    k = lead >> 6 & 15
    simple &= (lead >> 10 == 0) & (k < 8)  # method 0, one partition, a parameter that has a table
    fast = np.flatnonzero(simple)
    residual, _, long = _rice(data, at[fast] + 10, k[fast], size[fast] - order[fast])
    out: list[bytes] = [b""] * len(frames)
    for o in range(3):
        rows = np.flatnonzero((order[fast] == o) & ~long)
        if not len(rows):
            continue
        values, place = residual[rows], (a + head + 1)[fast[rows]]
        warm = [data[place + j].astype(np.int8).astype(np.int32) for j in range(o)]
        if o == 2:
            values = np.cumsum(np.column_stack([warm[1] - warm[0], values]), axis=1)
        if o:
            values = np.cumsum(np.column_stack([warm[0], values]), axis=1)
        pcm, width = values.astype(np.int8).tobytes(), values.shape[1]
        for r, f in enumerate(fast[rows].tolist()):
            out[f] = pcm[r * width : r * width + int(size[f])]
    for f in [*np.flatnonzero(~simple).tolist(), *fast[long].tolist()]:
        i = stream[f]
        try:
            values, _ = plain_subframe(streams[i], int(a[f] - shift[f] + head[f]), int(size[f]))
            out[f] = np.array(values).astype(np.int8).tobytes()
        except (ValueError, IndexError) as e:
            errors[i] = errors[i] or f"{e}"
    return out


def feature(pcm: bytes) -> str:
    """Energy, zero crossings and peak of the samples."""
    x = np.frombuffer(pcm, np.int8).astype(np.int64)
    return f"energy={int(x @ x)};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max(initial=0))}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the texts as FLAC streams."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks:
            media = encode_streams([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_blocks(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", work)


def decode(streams: DataFrame) -> DataFrame:
    """streams (doc_id, n_bytes, media) with pcm (unsigned 8-bit samples, as in WAV), the first sample of each block, a feature and an error."""

    def work(blocks) -> Iterator[pa.RecordBatch]:
        for batch, media in blocks:
            pcm, firsts, errors = decode_streams(media)
            features = [None if x is None else feature(x) for x in pcm]
            unsigned = [None if x is None else (np.frombuffer(x, np.uint8) ^ 128).tobytes() for x in pcm]
            new = [pa.array(unsigned, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(features, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), *new], names=["doc_id", "n_bytes", "media", "pcm", "block_starts", "feature", "error"])

    return map_blocks(streams.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, media binary, pcm binary, block_starts array<bigint>, feature string, error string", work, "media")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, pcm) of the sound streams in decode's result."""
    ends = F.concat(F.slice("block_starts", 2, F.greatest(F.size("block_starts") - 1, F.lit(0))), F.array(F.octet_length("pcm").cast("long")))
    spans = F.arrays_zip(F.col("block_starts").alias("first"), ends.alias("end"))
    rows = decoded.where("pcm IS NOT NULL").select("doc_id", "pcm", F.posexplode(spans).alias("block", "s"))
    size = (F.col("s.end") - F.col("s.first")).alias("n_samples")
    return rows.select("doc_id", "block", F.col("s.first").alias("first_sample"), size, F.substring("pcm", (F.col("s.first") + 1).cast("int"), size.cast("int")).alias("pcm"))


def samples_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, first, n, pcm): the samples from first on, n of them or as many as there are, of each row of wanted (doc_id, first, n).

    Doc_ids name one stream each; null ones, and stretches that begin beyond the end, give no row.
    """
    w = wanted.select("doc_id", "first", "n").distinct()
    met = blocks.join(w, "doc_id").where("first_sample < first + n AND first_sample + n_samples > first")
    a, b = F.greatest(F.col("first") - F.col("first_sample"), F.lit(0)), F.least(F.col("first") + F.col("n") - F.col("first_sample"), F.col("n_samples"))
    part = met.select("doc_id", "first", "n", "block", F.substring("pcm", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))
    parts = part.groupBy("doc_id", "first", "n").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return parts.select("doc_id", "first", "n", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), "")).alias("pcm"))
