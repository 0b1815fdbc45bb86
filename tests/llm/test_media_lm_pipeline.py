"""FLAC round trips, the language model, and the pipeline's stages."""

import hashlib
import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from tokenizers import Tokenizer

from ledgerlake.llm import flac, lm, simhash
from ledgerlake.llm.common import stored
from ledgerlake.llm.queries import QUERIES, WORD_VOCABULARY

from .conftest import pairs
from .test_dedup import _similar_groups, _without_windows

SF = "/root/testdata/sf0.001"


def test_streams_give_their_payload_back(odd, empty):
    rows = flac.decode(flac.encode(odd)).collect()
    texts = {(i, len(t.encode())): flac.payload(t.encode()) for i, t in pairs(odd)}
    for r in rows:
        assert r.error is None and bytes(r.pcm) == texts[r.doc_id, r.n_bytes] and r.block_starts == list(range(0, len(r.pcm), flac.FRAME))
    assert len(rows) == odd.count() and flac.decode(flac.encode(empty)).count() == 0


def test_query_columns_of_media(spark):
    rows = QUERIES["op5_flac_media"](spark, SF).collect()
    texts = {i: flac.payload(t.encode()) for i, t in pairs(spark.read.parquet(f"{SF}/documents.parquet"))}
    sizes = {i: len(t.encode()) for i, t in pairs(spark.read.parquet(f"{SF}/documents.parquet"))}
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (sizes[r.doc_id], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = flac.encode_streams([data])[0]
        assert (r.media_bytes, r.media_sha256, r.error) == (len(media), hashlib.sha256(media).hexdigest(), None)
        x = [b - 128 for b in data]
        assert r.feature == f"energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};peak={max(map(abs, x))}"


def test_hard_payloads_and_broken_streams():
    rng = np.random.default_rng(1)
    payloads = [flac.payload(x) for x in (b"", b"a", bytes(range(256)) * 9, b"\xff\x00" * 700, rng.bytes(5000), b"x" * 1025)]
    streams = flac.encode_streams(payloads)
    pcm, _, errors = flac.decode_streams(streams)
    assert errors == [None] * len(payloads) and [(np.frombuffer(x, np.uint8) ^ 128).tobytes() for x in pcm] == payloads
    whole = streams[2]
    flipped = whole[:300] + bytes([whole[300] ^ 1]) + whole[301:]
    _, _, errors = flac.decode_streams([whole, flipped, whole[:150], b"junk", None])
    assert errors[0] is None and errors[1] == "frame CRC-16" and all(errors[2:])


def test_streams_without_seek_points():
    stream = flac.encode_streams([bytes(range(256)) * 9])[0]
    begin = flac._metadata(stream)[3]
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[begin:]
    assert flac.decode_streams([bare])[0] == flac.decode_streams([stream])[0]


def _bits(*fields):
    text = "".join(f"{v & (1 << n) - 1:0{n}b}" if n else v for v, n in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)


@pytest.mark.parametrize(
    "subframe, samples",
    [
        (_bits((0, 8), (-5, 8)), [-5] * 4),
        (_bits((2, 8), (1, 8), (-2, 8), (3, 8), (-4, 8)), [1, -2, 3, -4]),
        # first-order prediction, two partitions, the second an escape of 4 bits
        (_bits((0b00010010, 8), (10, 8), (0, 2), (1, 4), (0, 4), ("001", 0), (15, 4), (4, 5), (3, 4), (-1, 4)), [10, 11, 14, 13]),
        # linear prediction with weight 2 / 2**1 over one sample
        (_bits((0b01000000, 8), (7, 8), (3, 4), (1, 5), (2, 4), (0, 2), (0, 4), (1, 4), ("101", 0), ("100", 0), ("110", 0)), [7, 7, 6, 3]),
    ],
)
def test_subframes_of_other_kinds(subframe, samples):
    found, _ = flac.plain_subframe(subframe, 0, 4)
    assert found == samples


class Slow:
    """An independent decoder: the stream as a string of bits, one code after another."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def u(self, n):
        self.at += n
        return int("0" + self.bits[self.at - n : self.at], 2)

    def s(self, n):
        x = self.u(n)
        return x - 2**n if n and x >= 2 ** (n - 1) else x

    def unary(self):
        end = self.bits.index("1", self.at)
        n, self.at = end - self.at, end + 1
        return n

    def residuals(self, size, order):
        assert self.u(2) == 0
        parts = 2 ** self.u(4)
        for p in range(parts):
            k = self.u(4)
            for _ in range(size // parts - (order if p == 0 else 0)):
                x = self.unary() * 2**k + self.u(k)
                yield -(x + 1) // 2 if x % 2 else x // 2

    def subframe(self, size):
        assert self.u(1) == 0
        kind = self.u(6)
        assert self.u(1) == 0
        if kind < 8:
            return [self.s(8)] * size if kind == 0 else [self.s(8) for _ in range(size)]
        order = kind - 8 if kind < 32 else kind - 31
        x = [self.s(8) for _ in range(order)]
        if kind < 32:
            weights, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order], 0
        else:
            precision = self.u(4) + 1
            shift = self.s(5)
            weights = [self.s(precision) for _ in range(order)]
        for r in self.residuals(size, order):
            x.append(r + sum(w * x[-1 - j] for j, w in enumerate(weights)) // 2**shift)
        return x

    def stream(self):
        assert self.u(32) == int.from_bytes(b"fLaC")
        last = 0
        while not last:
            last, _, n = self.u(1), self.u(7), self.u(24)
            self.at += 8 * n
        out = []
        while self.at < len(self.bits):
            assert self.u(15) == 0b111111111111100 and self.u(1) == 0
            size = {10: 1024, 7: 0}[self.u(4)]
            self.u(12)
            while self.u(8) >= 0xC0 or self.bits[self.at : self.at + 2] == "10":
                pass
            size = size or self.u(16) + 1
            self.u(8)
            out += self.subframe(size)
            self.at += -self.at % 8 + 16
        return bytes(x + 128 for x in out)


def test_streams_by_an_independent_decoder():
    rng = np.random.default_rng(3)
    payloads = [flac.payload(x) for x in (b"", b"words and more words, " * 90, bytes(range(256)) * 5, rng.bytes(1500), bytes((np.cumsum(rng.integers(-2, 3, 2100)) % 256).astype(np.uint8)))]
    streams = flac.encode_streams(payloads)
    assert [Slow(x).stream() for x in streams] == payloads
    assert [(np.frombuffer(x, np.uint8) ^ 128).tobytes() for x in flac.decode_streams(streams)[0]] == payloads


@pytest.mark.parametrize("weights, shift", [([13], 4), ([29, -14], 4), ([40, -30, 9], 5), ([-3, 2, 1, -1, 3, 2, -2, 1], 3)])
def test_linear_prediction(weights, shift):
    """Frames with LPC subframes, in whole streams: what both decoders read is what was coded."""
    rng, order, size = np.random.default_rng(len(weights)), len(weights), 1024
    x = np.clip(np.cumsum(rng.integers(-6, 7, size)), -128, 127).tolist()
    residual = [x[i] - sum(w * x[i - 1 - j] for j, w in enumerate(weights)) // 2**shift for i in range(order, size)]
    zigzag = [2 * r if r >= 0 else -2 * r - 1 for r in residual]
    codes = "".join("0" * (z >> 4) + "1" + f"{z & 15:04b}" for z in zigzag)
    body = _bits((64 | order - 1 << 1, 8), *((v, 8) for v in x[:order]), (7 - 1, 4), (shift, 5), *((w, 7) for w in weights), (0, 2), (0, 4), (4, 4), (codes, 0))
    frame = flac.frame_header(0, size) + body
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.zeros(1, np.int64), np.array([len(frame)]))[0]).to_bytes(2)
    raw = flac.encode_streams([bytes(v + 128 for v in x)])[0]
    stream = raw[:4] + b"\x80" + raw[5:42] + frame + crc
    wanted = bytes(v + 128 for v in x)
    assert Slow(stream).stream() == wanted
    pcm, firsts, errors = flac.decode_streams([stream])
    assert errors == [None] and firsts == [[0]] and (np.frombuffer(pcm[0], np.uint8) ^ 128).tobytes() == wanted


def test_parts_are_read_from_the_blocks_that_hold_them(spark, odd):
    one = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    blocks = flac.pcm_blocks(flac.decode(flac.encode(one))).cache()
    texts = {i: flac.payload(t.encode()) for i, t in pairs(one)}
    found = {}
    for r in blocks.collect():
        assert r.first_sample == r.block * flac.FRAME and r.n_samples == len(r.pcm) and bytes(r.pcm) == texts[r.doc_id][r.first_sample : r.first_sample + r.n_samples]
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_samples
    assert found == {i: len(t) for i, t in texts.items()}
    wanted = [(6, 0, 10), (6, 1020, 8), (6, 1024, 1024), (6, 2000, 5000), (13, 9990, 500), (1, 60, 4), (1, 64, 5), (99, 0, 1), (None, 0, 1)]
    got = {(r.doc_id, r.first, r.n): bytes(r.pcm) for r in flac.samples_at(blocks, spark.createDataFrame(wanted, "doc_id long, first long, n long")).collect()}
    assert got == {(i, a, n): texts[i][a : a + n] for i, a, n in wanted if i in texts and a < len(texts[i])}


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (500, 100_000), (2000, 2100), (3, 2**30)):
        values = np.sort(rng.choice(min(top, 10**6), n, replace=False)).astype(np.int64) * max(1, top // 10**6)
        view, _ = lm.EliasFano.view(lm.EliasFano.build(values).to_bytes(), 0)
        asked = np.concatenate([values, rng.integers(0, 2 * top, 2000)])
        place = {int(v): i for i, v in enumerate(values)}
        assert view.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def _grams(rng, n=4000, words=30):
    near, second = (rng.zipf(1.5, n) % words for _ in range(2))
    symbol = (near * 7 + second + rng.integers(0, 3, n)) % words
    return lm.Grams(near * 2**33 + 5, second, symbol), near, second, symbol


def test_trie_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    grams, near, second, symbol = _grams(rng)
    train = (rng.random(len(near)) < 0.8).astype(float)
    first = np.bincount(symbol, minlength=lm.RARE + 1) / len(symbol)
    trie = lm.Trie.view(lm.Trie.build(grams, train, first).to_bytes())
    low = lm._quantised(np.maximum(first, 1e-30)).astype(np.int64)
    for a, b in ((1, 1), (1, 7), (2, 3), (29, 29), (555, 1), (1, 555)):
        asked = lm.Grams(np.full(30, a * 2**33 + 5), np.full(30, b), np.arange(30))
        steps = trie.steps(asked, low)[asked.triple]
        assert abs(sum(10 ** (-steps / lm.STEPS)) - 1) < 0.01


def _predicted(documents, use=3):
    """(doc_id, log10 probability) by the model's definition, with dictionaries; use: the longest n-gram."""
    texts = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2, [*t.encode().lower().split(), b"\n"]) for i, t in documents]
    count = Counter(w for _, train, words in texts if train for w in words)
    total, kinds = sum(count.values()), len(count)
    hot = {w for w, _ in sorted(((w, c) for w, c in count.items() if w != b"\n"), key=lambda x: (-x[1], np.uint64(xxhash.xxh3_64_intdigest(x[0])).astype(np.int64)))[:PREDICTED]} | {b"\n"}
    rare = sum(c for w, c in count.items() if w not in hot)
    first = lambda x: (count[x] if x else rare + kinds) / (total + kinds)
    after, kept = Counter(), Counter()
    for _, train, words in texts:
        for i, w in enumerate(words if train else []):
            for n in range(1, use):
                after[tuple(([b""] * 2 + words)[i + 2 - n : i + 2]), w if w in hot else None] += 1
    totals, left = Counter(), Counter()
    for (context, _), n in after.items():
        totals[context] += n
    for (context, x), n in after.items():
        if n >= lm.KEPT:
            kept[context, x] = (n - lm.DISCOUNTS[n > lm.KEPT]) / totals[context]
            left[context] += kept[context, x]

    def p(context, x):
        return kept[context, x] + (1 - left[context]) * p(context[1:], x) if context else first(x)

    for i, _, words in texts:
        score = 0.0
        for k, w in enumerate(words):
            context = tuple(([b""] * 2 + words)[k : k + 2])[3 - use :]
            score += math.log10(p(context, w if w in hot else None))
            if w not in hot:
                score += math.log10((count[w] or kinds) / (rare + kinds))
        yield i, len(words), score


PREDICTED = 700


@pytest.mark.parametrize("slice_tokens", [40_000, 3000])
def test_scores_are_those_of_the_definition(sample, slice_tokens):
    documents = pairs(sample)
    wanted = {i: (n, x) for i, n, x in _predicted(documents)}
    rows = lm.score(sample, slice_tokens=slice_tokens, predicted=PREDICTED).toPandas()
    for r in rows.itertuples():
        n, x = wanted[r.doc_id]
        assert r.n_tokens == n and abs(r.score - x) < 0.001 * n, r
    short = {i: x for i, _, x in _predicted(documents, use=1)}
    held = rows[rows.held_out]
    assert held.score.sum() > 0.99 * sum(short[i] for i in held.doc_id) and rows.score.sum() > 0.97 * sum(short.values())


def test_word_order_matters(spark, sample):
    turned = spark.createDataFrame([(i, " ".join(t.split()[::-1])) for i, t in pairs(sample) if i % 3 == 0], "doc_id long, text string")
    whole = sample.select("doc_id", "text").where("doc_id % 3 <> 0")
    ends = [{r.doc_id: r.score for r in lm.score(whole.unionByName(x)).collect()} for x in (turned, sample.select("doc_id", "text").where("doc_id % 3 = 0"))]
    assert ends[0].keys() == ends[1].keys() and sum(abs(ends[0][i] - ends[1][i]) > 0.5 for i in ends[0]) > len(ends[0]) / 4


@pytest.mark.parametrize("slice_tokens", [20_000, 2000, 400])
def test_scores_do_not_depend_on_slices(spark, sample, slice_tokens):
    """Hot words and pairs are spread over slices; the scores are those of one slice. A step of a logarithm is 0.0005; sums of floats may differ in their last bits."""
    docs = sample.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, "same same other " * 60) for i in range(40)], "doc_id long, text string"))
    wanted = {r.doc_id: r for r in lm.score(docs, predicted=PREDICTED).collect()}
    rows = lm.score(docs, slice_tokens=slice_tokens, predicted=PREDICTED).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        w = wanted[r.doc_id]
        assert tuple(r)[:5] == tuple(w)[:5] and abs(r.base_score - w.base_score) < 1e-6 and abs(r.score - w.score) < 1e-6
    known = lm.vocabulary(docs, slice_tokens, PREDICTED)
    lm.hot_contexts(docs, known)
    assert len(known.hot_words) > (0 if slice_tokens > 2000 else 2) and (slice_tokens > 2000 or len(known.hot_pairs) > 1)


def test_hot_contexts_are_spread(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a b w{j % 40} a x{(i * j) % 90}" for j in range(200))) for i in range(20)], "doc_id long, text string")
    known = lm.vocabulary(docs, 400, PREDICTED)
    lm.hot_contexts(docs, known)
    rng, n = np.random.default_rng(1), 4000
    word = int(np.argmax(known.pieces))
    second = rng.integers(0, 50, n)
    assert np.unique(known.slice_of(np.full(n, word), second, rng.integers(0, 9, n))).size > known.slices // 2 > 4
    most = int(np.argmax(known.pair_pieces))
    pair = known.hot_pairs[most]
    slices = known.slice_of(np.full(n, pair >> lm.SECOND), np.full(n, pair & (1 << lm.SECOND) - 1), rng.integers(0, 99, n))
    assert 1 < np.unique(slices).size <= known.pair_pieces[most]
    followers = np.arange(99)
    rows, to = known.slices_for(np.full(99, pair >> lm.SECOND), followers)
    held = set(zip(followers[rows].tolist(), to.tolist()))
    for symbol in range(99):  # wherever an occurrence is dealt, its follower is told
        for bits in (pair & (1 << lm.SECOND) - 1, 5, 77):
            assert (symbol, int(known.slice_of(np.array([pair >> lm.SECOND]), np.array([bits]), np.array([symbol]))[0])) in held


def _base(documents):
    train = Counter()
    for i, t in documents:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update([*t.encode().lower().split(), b"\n"])
    total, kinds = sum(train.values()), len(train)
    for i, t in documents:
        tokens = [*t.encode().lower().split(), b"\n"]
        yield i, len(tokens), sum(train[w] > 0 for w in tokens), total, sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in tokens)


def test_base_scores_of_odd_rows(odd, empty):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(odd).collect()), key=key)
    for a, b in zip(found, sorted(_base(pairs(odd)), key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
    assert lm.score(empty).count() == 0


def test_model_beats_the_base_on_held_out_rows(spark):
    rows = QUERIES["op9_lm_scoring"](spark, SF).where("held_out").toPandas()
    assert len(rows) > 10 and rows.score.sum() > rows.base_score.sum()


def test_stages_keep_columns_and_take_effect(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns, name
        docs = out
    assert docs.count() < odd.count()


def _rejected(text):
    """The quality rules, one by one."""
    words = text.encode().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(runs)
    repeated = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + 5)}
    full = [x for x in text.encode().split(b"\n") if x.split()]
    letters, capitals = (sum(c.isascii() and c.isalpha() and (kind is None or c.isupper()) for c in text) for kind in (None, 1))
    chars = sum(len(w.decode()) for w in words)
    return (
        len(words) < 10 or 100 * len(repeated) > 20 * len(words) or 4 * sum(c in "#*$%&|<>" for c in text) > len(words) or 10 * (len(full) - len(set(full))) > 5 * len(full)
        or chars < 2 * len(words) or chars > 40 * len(words) or (letters >= 50 and 10 * capitals > 6 * letters)
    )


def _line(x):
    return x.strip(" \t\n\x0b\x0c\r").encode().lower()


def test_stages_equal_brute_force(spark):
    """Each stage, on what the one before gave, against its rule; then every token of what is left is in one piece."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(70))
    texts = ["few words", "x " * 40, "A LOUD TEXT " * 3 + " ".join(word() for _ in range(40)), "# " * 30 + " ".join(word() for _ in range(50)), None, ""]
    for i in range(60):
        own = [" ".join(word() for _ in range(12)) for _ in range(8)]
        texts.append("\n".join([*own, *(["  Shared LINE of many "] if i % 4 == 0 else []), *([passage] if i % 7 == 0 else [])]))
    for i in range(12):  # near copies of some, with one to six words changed
        words = texts[10 + i].split(" ")
        for p in rng.choice(len(words), 1 + i // 2, replace=False):
            words[p] = word()
        texts.append(" ".join(words))
    texts += [texts[20]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stages = {name: out for name, out in _through(spark, docs)}
    want = {i: t for i, t in enumerate(texts) if not _rejected(t or "")}
    assert stages["quality rules"] == want and len(want) < len(texts)
    often = {k for k, n in Counter(k for t in want.values() for k in {_line(x) for x in t.split("\n")} if k).items() if n >= 10}
    want = {i: "\n".join(x for x in t.split("\n") if _line(x) not in often) for i, t in want.items()}
    assert often and stages["line dedup"] == want
    group = dict(zip(want, _similar_groups([t.lower() for t in want.values()])))
    first = {}
    for i in sorted(want):
        first.setdefault(group[i], i)
    want = {i: want[i] for i in first.values()}
    assert stages["SimHash near-dedup"] == want and len(want) < len(group)
    left = {i: (text, gone) for i, _, gone, text in _without_windows(sorted(want.items()), 50)}
    want = {i: left[i][0] if left[i][1] else t for i, t in want.items()}
    assert stages["substring dedup"] == want and any(gone for _, gone in left.values())
    ids = Counter()
    for r in stages["packing"].collect():
        ids[r.doc_id] += r.length
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    assert ids == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def _through(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            yield name, out
            return
        docs = stored(out, "test-stage")
        yield name, {r.doc_id: r.text for r in docs.collect()}


def test_near_dedup_recall_on_given_documents(spark):
    """Pairs of the given documents at similarity 0.8 or more: the stage's groups join at least nine of ten (all, as a rule), and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(pairs(docs))
    sets = {i: frozenset(w[k : k + 5] for w in [tuple(t.lower().split())] for k in range(max(1, len(w) - 4))) for i, t in rows if t.split()}
    holders, links = {}, set()
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for h in holders.values() if len(h) < 200 for k, a in enumerate(h) for b in h[k + 1 :])
    links = {(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}
    found = {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()}
    joined = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 50 and joined >= 0.9 * len(links)


def test_pipeline_runs_from_end_to_end(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and set(rows.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 2048
