"""Token ids by way of caches of text pieces.

A text is cut at every blank. No token of the two vocabularies reaches over such a cut as long as
no other white space touches it, so the ids of a text are those of its pieces, one after the other.
A piece is looked up whole; on a miss it is cut into pre-tokens, and only pre-tokens that are new to
the worker reach the tokenizers library. Pieces with characters whose treatment could depend on
Unicode tables, texts with touching white space, and texts with special tokens go to the library as
they are.
"""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit integers")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of the younger half of a worker's caches. When it is full it becomes the older half, whose own entries go.
PIECES_HELD, PRE_TOKENS_HELD = 250_000, 350_000
#: The same for vocabularies of words, which have fewer pre-tokens as case is folded.
WORD_PIECES_HELD, WORDS_HELD = 120_000, 150_000
ENDS = frozenset(".,;:!?")
PLAIN = regex.compile(r"[\t\n\r -~¡-ÿ]*")


class Touching(Exception):
    """White space beside a cut: the text must be encoded whole."""


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and vocabulary."""
    return PieceEncoder(path)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of a piece as little-endian unsigned 32-bit integers."""

    def __init__(self, make, held: int):
        self.make, self.held = make, held
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.make(piece)
        if len(self) >= self.held:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class PieceEncoder:
    """Encodes whole texts with one ``tokenizers`` file, equal to its ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        self.keeps_blanks = pre["type"] == "ByteLevel"
        if self.keeps_blanks:
            if norm is not None or pre["add_prefix_space"] or not pre["use_regex"]:
                raise ValueError(f"{path}: this byte-level set-up is not known")
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        else:
            split, level = pre["pretokenizers"]
            kinds = [n["type"] for n in norm["normalizers"]]
            if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
                raise ValueError(f"{path}: this set-up is not known")
            pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.alphabet = byte_alphabet()
        self.blank = self.alphabet[0x20]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # what comes here is new to the worker
        pieces_held, held = (PIECES_HELD, PRE_TOKENS_HELD) if self.keeps_blanks else (WORD_PIECES_HELD, WORDS_HELD)
        self.spaced = _Pieces(lambda word: self._pre_token(" " + word), held)
        self.bare = _Pieces(self._pre_token, held)
        #: By the piece without the blank before it, where the vocabulary keeps blanks.
        self.pieces = _Pieces(self._spaced_piece if self.keeps_blanks else self._word_piece, pieces_held)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pre_token(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():
            shown = token.replace(" ", self.blank)
        else:
            shown = token.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _odd(self, piece: str) -> bool:
        return not PLAIN.fullmatch(piece) or any(s in piece for s in self.specials)

    def _spaced_piece(self, piece: str) -> bytes:
        """The ids of a blank and the piece."""
        if piece.isalpha() and (piece.isascii() or PLAIN.fullmatch(piece)):
            return self.spaced[piece]
        if piece[-1:] in ENDS and piece[:-1].isalpha() and PLAIN.fullmatch(piece):
            return self.spaced[piece[:-1]] + self.bare[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Touching
        if self._odd(piece):
            return self._library(" " + piece)
        return b"".join(self.spaced[t[1:]] if t[0] == " " else self.bare[t] for t in self.pattern.findall(" " + piece))

    def _word_piece(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or PLAIN.fullmatch(piece)):
            return self.bare[piece.lower()]
        if piece[-1:] in ENDS and piece[:-1].isalpha() and PLAIN.fullmatch(piece):
            return self.bare[piece[:-1].lower()] + self.bare[piece[-1]]
        if self._odd(piece):
            return self._library(piece)
        return b"".join(map(self.bare.__getitem__, self.pattern.findall(piece.lower())))

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The beginning of a text, up to its first blank, and the pieces after it."""
        rest = text.split(" ")
        return rest.pop(0), rest

    def beginning(self, first: str) -> bytes:
        if not self.keeps_blanks:
            return self.pieces[first]
        if first[-1:].isspace():
            raise Touching
        if self._odd(first):
            return self._library(first)
        return b"".join(map(self.bare.__getitem__, self.pattern.findall(first)))

    def encode(self, text: str) -> bytes:
        """All ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, rest = self.cut(text)
        try:
            return self.beginning(first) + b"".join(map(self.pieces.__getitem__, rest))
        except Touching:
            return self._library(text)

    def piece_length(self, piece: str) -> int:
        return len(self.pieces[piece]) // 4
