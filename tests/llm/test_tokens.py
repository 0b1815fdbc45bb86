"""Packing, byte-level BPE, wavelet files: ids equal the libraries', and every id is kept."""

import base64
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import byte_bpe, packing, wavelet
from ledgerlake.llm.token_ids import TokenIds, spaced_words_of, words_of

from .conftest import ROWS, pairs

WORDS, BYTES, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
TEXTS = [t or "" for _, t in ROWS] + ["Σίσυφος ΌΣ ё é é x́", "x²³¼ ÀÉİ Ǆ  \n 're\x00", "a" * 3000]


def library(path, special_as_text=True):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path, cut", [(WORDS, words_of), (BYTES, spaced_words_of)])
def test_ids_of_pieces_are_ids_of_the_text(path, cut, sample):
    texts = TEXTS + [t for _, t in pairs(sample)]
    assert TokenIds(path, cut).encode([t.encode() for t in texts]) == library(path)(texts)


@pytest.mark.parametrize("path, cut", [(WORDS, words_of), (BYTES, spaced_words_of)])
def test_special_strings_are_text_or_special_ids(path, cut):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|startoftext|>\ny", "<|endoftext", "plain text. <|"]
    for as_text in (True, False):
        assert TokenIds(path, cut, as_text).encode([t.encode() for t in texts]) == library(path, as_text)(texts)
    assert TokenIds(path, cut).encode([texts[0].encode()]) != TokenIds(path, cut, False).encode([texts[0].encode()])


@pytest.mark.parametrize("path, cut", [(WORDS, words_of), (BYTES, spaced_words_of)])
def test_ids_do_not_depend_on_what_a_worker_holds(path, cut, sample):
    encoder, texts = TokenIds(path, cut), TEXTS + [t for _, t in pairs(sample)]
    encoder.cache.limit = encoder.parts.limit = 3
    assert [encoder.encode([t.encode()])[0] for t in texts] == library(path)(texts)


def _check_packing(rows, documents, capacity):
    ids = defaultdict(list)
    for (doc_id, _), x in zip(documents, library(WORDS)([t for _, t in documents])):
        ids[doc_id].append(x + np.array([1], "<u4").tobytes())
    windows, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids)
        windows[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append((r.doc_tokens, r.start, bytes(r.ids)))
    for window in windows.values():
        ends = np.cumsum([n for _, n in sorted(window)])
        assert [a for a, _ in sorted(window)] == [0, *ends[:-1]] and ends[-1] <= capacity
    for doc_id, wanted in ids.items():
        assert sum(len(b) for _, _, b in texts[doc_id]) == sum(map(len, wanted))
        if len(wanted) == 1:
            assert b"".join(b for _, _, b in sorted(texts[doc_id])) == wanted[0]
    return sum(n for w in windows.values() for _, n in w) / (capacity * len(windows))


def test_packing_keeps_every_token(odd, sample):
    _check_packing(packing.pack(odd, WORDS, 256).collect(), pairs(odd), 256)
    assert _check_packing(packing.pack(sample.coalesce(1), WORDS).collect(), pairs(sample), 2048) > 0.99


def test_packing_of_nothing(empty):
    assert packing.pack(empty, WORDS).count() == 0


def test_level_is_the_one_of_least_squares():
    rng = np.random.default_rng(3)
    packer = packing.SumOfSquares(16)
    for size in rng.integers(1, 16, 400).tolist():
        def squares(h):
            n = packer.levels.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())

        options = [h for h in range(17 - size) if h == 0 or packer.levels[h]]
        assert squares(packer.level_for(size)) == min(map(squares, options))
        packer.place((0,), size)


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(odd, sample):
    library = _tiktoken()
    docs = odd.select("doc_id", "text").unionByName(sample.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    found = sorted((r.doc_id or -1, r.n_tokens, bytes(r.decimals), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect())
    wanted = sorted((i or -1, len(x := library.encode_ordinary(t)), ",".join(map(str, x)).encode(), t.encode()) for i, t in pairs(docs))
    assert found == wanted


def test_pretokens_of_random_texts_equal_tiktoken():
    rng, library, encoder = np.random.default_rng(4), _tiktoken(), byte_bpe.Encoder(RANKS)
    parts = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "!", "é", "1", "a", "　", "'ve", "d", "中", "\x00", "\r\n", "½", "\U000323b0"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder([t.encode() for t in texts])] == [library.encode_ordinary(t) for t in texts]


def test_classes_are_those_of_the_pattern():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", byte_bpe.LETTER), (r"\p{N}", byte_bpe.NUMBER), (r"\s", byte_bpe.SPACE)):
        one = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        assert set(map(ord, bytes(one.encode_ordinary(text)).decode())) == set(np.flatnonzero(byte_bpe.classes() == kind).tolist())


def test_part_of_a_text_is_decoded_alone():
    encoder, vocabulary = byte_bpe.Encoder(RANKS), byte_bpe.Vocabulary(RANKS)
    text = (ROWS[7][1] * 3).encode()
    ids = encoder([text])[0]
    offsets = vocabulary.offsets(ids)
    for a, b in ((0, 5), (1000, 1001), (4000, 9000), (0, len(text)), (len(text) - 3, len(text))):
        assert vocabulary.decode_part(ids, offsets, a, b) == text[a:b]


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 50_000, 4000), rng.integers(0, 3, 513), np.array([7]), np.zeros(1024)):
        ids = ids.astype(np.uint32)
        _, sizes, m = wavelet.read_file(wavelet.write_file([1, None], [len(ids), 0], ids))
        assert (m.decode() == ids).all() and sizes.tolist() == [len(ids), 0]
        for place in rng.integers(0, len(ids), 30).tolist():
            value = int(ids[place])
            assert m.access(place) == value and m.rank(value, place) == int((ids[:place] == value).sum()) and m.count(value) == int((ids == value).sum())
        places = np.flatnonzero(ids == ids[0]).tolist()
        assert m.occurrences(int(ids[0])).tolist() == places == [m.select(int(ids[0]), k) for k in range(len(places))]
        assert m.count(1 << 20) == 0 and not len(m.occurrences(1 << 20))


def test_files_hold_all_documents_in_order(odd, empty):
    files = wavelet.write(odd, BYTES, 2, shard_tokens=500)
    documents = sorted(pairs(odd), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ids = [x + np.array([2], "<u4").tobytes() for x in library(BYTES)([t for _, t in documents])]
    found = sorted((r.start, r.doc_id, bytes(r.ids)) for r in wavelet.read(files).select("start", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "ids").collect())
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)]).tolist()
    assert [x[2] for x in found] == ids and [x[0] for x in found] == starts[:-1] and [x[1] for x in found] == [-1 if i is None else i for i, _ in documents]
    assert files.count() > 2 and wavelet.occurrences(files, 2).count() == len(documents)
    assert wavelet.read(wavelet.write(empty, BYTES, 2)).count() == 0
