"""Token ids of whole texts by the tokenizers library, with the ids of words kept.

Both vocabularies used here cut a text before every merge, and never across a single white-space character between two other
characters. So a text is split there, each distinct piece is encoded once by the library, and a text's ids are its pieces' ids
in order. Pieces with runs of white space are never split. A text that holds the string of a special token, in any case, goes
to the library as a whole, which gives it that token's id.

Defined results: an empty text has no ids; texts of any length are encoded whole; words beyond the bound of the kept tables are
encoded anew.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Distinct pieces that one worker keeps in each of two tables, about 250 bytes each; beyond it all are forgotten.
KEPT = 600_000
#: Letters that normalisation by NFC leaves alone, and ASCII signs after them: the usual word.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
_SPLIT = re.compile(r"(?<=\S)(?=\s\S)")
_WHITE = re.compile(r"\s")
#: White space to Python but not to the vocabularies.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Encoded pieces by their text."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        ids = self.encode(piece)
        if len(self) >= KEPT:
            self.clear()
        self[piece] = ids
        return ids


class Irregular(Exception):
    """A text whose white space isn't single."""


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``width`` bytes each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special, self.lead = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I), re.match(r"[^a-zA-Z]*", os.path.commonprefix(special))[0]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.letters = _byte_letters()
        self.drops_white = self.tokenizer.normalizer is not None  # the word vocabulary; the byte vocabulary has none
        self.pieces = _Pieces(self._piece)
        self.after_space = _Pieces(self._after_space)

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, part: str) -> bytes:
        """A part that the vocabulary doesn't cut, straight to the merges."""
        return self._pack([t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in part.encode()]))])

    def _word(self, piece: str, lead: str) -> bytes | None:
        if (m := _WORD.match(piece)) is None:
            return None
        word = m[1].lower() if self.drops_white else m[1]
        if not m[2]:
            return self._model(lead + word)
        return (self.after_space if lead else self.pieces)[m[1]] + self.pieces[m[2]]

    def _piece(self, piece: str) -> bytes:
        got = self._word(piece, "")
        return self._library(piece) if got is None else got

    def _after_space(self, piece: str) -> bytes:
        if not piece or piece == "\n" or _WHITE.search(piece, 1):
            raise Irregular
        if piece[0] == "\n":
            return self.pieces[piece]
        if piece[0].isspace():
            raise Irregular
        got = self._word(piece, " ")
        return self._library(" " + piece) if got is None else got

    def encode(self, text: str) -> bytes:
        if self.lead in text and self.special.search(text):
            return self._library(text)
        if self.drops_white:
            if _ODD.search(text):
                return self._library(text)
            return b"".join(map(self.pieces.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or _WHITE.search(first):
                raise Irregular
            return self.pieces[first] + b"".join(map(self.after_space.__getitem__, rest))
        except Irregular:
            return b"".join(map(self.pieces.__getitem__, _SPLIT.split(text))) if text else b""


_BY_PATH: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and worker process."""
    if path not in _BY_PATH:
        _BY_PATH[path] = Encoder(path)
    return _BY_PATH[path]
