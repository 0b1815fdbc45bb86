"""Token ids of whole texts from a tokenizers vocabulary, each distinct piece encoded once.

A text is cut only where the vocabulary's own pre-tokenizer always cuts, so
ids of the pieces, joined, are the ids of the text.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import cache

from .common import PieceCache

#: Pieces whose ids a worker holds, at least; twice as many at most.
HELD_PIECES = 700_000
# The Unicode White_Space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def words_of(text: bytes) -> list[bytes]:
    """For vocabularies that drop white space: the runs between ASCII white space."""
    return text.split()


_spaced = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall


def spaced_words_of(text: bytes) -> list[str]:
    """For byte-level vocabularies: each run of other characters with the white space before it."""
    return _spaced(text.decode())


# What keeps a text from being cut at single spaces and line feeds alone: other white space, or two in a row.
_UNEVEN = [b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def evenly_spaced(text: bytes) -> bool:
    """Whether white space is single spaces and line feeds only, so that each starts a piece."""
    return not any(map(text.__contains__, _UNEVEN))


#: Below this code point NFC changes nothing and letter and number classes are settled.
_PLAIN = 0x250
_beyond = re.compile(f"[^\0-{chr(_PLAIN - 1)}]").search
# The contractions that both vocabularies' pre-tokenizers split off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _of_category(letter: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == letter)


def _plain_splitters() -> tuple:
    letter, number = _of_category("L"), _of_category("N")
    other = f"[^{WHITE_SPACE}{letter}{number}]+"
    word = re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|{other}")
    spaced = re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?{other}|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
    return word.findall, spaced.findall


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class TokenIds:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens.

    The library's call has a high price for each input, so new pieces of plain
    Latin letters are split here and given to the library's BPE model one
    pre-token at a time; all others go through its whole encoder. Words without
    punctuation are kept once, whether they stand alone or beside some.

    special_as_text: strings of special tokens in a text are ordinary text, as
    the vocabularies' own notes have it; otherwise each is its special id.
    """

    def __init__(self, path: str, cut, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut, self.cache = cut, PieceCache(self._make, HELD_PIECES)
        self.spaced = cut is not words_of
        word, spaced = _plain_splitters()
        self.split = spaced if self.spaced else word
        self.letters = _byte_letters()
        self.parts = PieceCache(self._part, 50_000)
        self.tokenize = self.tokenizer.model.tokenize

    def _make(self, piece: bytes | str) -> bytes:
        """Ids of a piece. In vocabularies that keep white space, bytes stand for themselves after a space, or after nothing before a line feed."""
        plain = piece.isascii()
        if isinstance(piece, bytes) and plain and piece.isalpha():
            return self._ids(self.letters[0x20] + piece.decode() if self.spaced else piece.decode().lower())
        text = piece.decode() if isinstance(piece, bytes) else piece
        if text is not piece and self.spaced and not text.startswith("\n"):
            text = " " + text
        lower = text if self.spaced else text.lower()
        if not plain and _beyond(lower):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.split(lower)
        if len(parts) == 1:
            return self._part(lower)
        words, known = self.cache.now.__getitem__, self.parts.lookup()
        return b"".join([words(w) if (w := self._word(x)) else known(x) for x in parts])

    def _word(self, part: str) -> bytes:
        """The piece that a part is by itself, if it is ASCII letters."""
        word = part[1:] if self.spaced and part[0] == " " else "" if self.spaced else part
        return word.encode() if word.isascii() and word.isalpha() else b""

    def _ids(self, lettered: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(lettered)]).tobytes()

    def _part(self, piece: str) -> bytes:
        return self._ids(self._lettered(piece))

    def _lettered(self, piece: str) -> str:
        """The piece with a letter for each byte; printable ASCII but the space stands for itself."""
        if piece.isascii() and piece.isprintable():
            return self.letters[0x20] + piece[1:] if piece[0] == " " else piece
        return piece.encode().decode("latin-1").translate(self.letters)

    def encode(self, texts: list[bytes], end: int | None = None) -> list[bytes]:
        tail = b"" if end is None else array("I", [end]).tobytes()
        known = self.cache.lookup()
        return [self._whole(t, known) + tail for t in texts]

    def _whole(self, text: bytes, known) -> bytes:
        if any(map(text.__contains__, self.special)):
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return self._spaced(text, known) if self.spaced else b"".join(map(known, self.cut(text)))

    def _spaced(self, text: bytes, known) -> bytes:
        """Ids of a text with white space kept. A piece of bytes stands for itself after a space, or after nothing if it starts with a line feed."""
        if not evenly_spaced(text):
            return b"".join(map(known, self.cut(text)))
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        return (known(first.decode()) if first else b"") + b"".join(map(known, rest))


@cache
def token_ids_of(path: str, cut, special_as_text: bool = True) -> TokenIds:
    """One encoder for all tasks that a worker runs, so that its cache stays warm."""
    return TokenIds(path, cut, special_as_text)
