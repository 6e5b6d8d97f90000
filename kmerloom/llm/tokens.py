"""Token ids of whole texts by the files of the tokenizers library.

A text is cut at white space that no pre-token crosses, each distinct piece is
encoded once, and the ids are joined as bytes (little-endian unsigned
32-bit): the ids of the whole text, at the cost of a dictionary lookup a piece.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import partial

import numpy as np
from tokenizers import Tokenizer

#: Pieces kept in memory in each of two generations: when the younger is full it becomes the older.
CACHE = 250_000
#: White space beside white space or at an end: the cut at single spaces would not be exact.
_IRREGULAR = re.compile(r"\s\s|\A\s|\s\Z")


#: Marks that may be pre-tokens of their own after letters, and kinds of their sequences that are kept.
_MARKS, KINDS = ".,;:!?$%&#*@+=/|()[]{}<>~^-", 4096


#: Letters up to here are letters to every library, and a run of them is one pre-token.
_LATIN = "\u024f"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes of byte-level tokenizers: printable Latin-1 stands for itself, the rest for 256 and up."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in itself else next(rest)) for b in range(256)}


class _Irregular(Exception):
    """A piece is empty, or has irregular white space of other kinds than the cuts."""


class _Cache(dict):
    """Ids of pieces. A mark after letters only is encoded apart, so words are met again with and without it."""

    def __init__(self, encode, word, prefix: str, folds: bool, drops: bool):
        self.encode, self.word, self.prefix, self.folds, self.drops, self.older = encode, word, prefix, folds, drops, {}
        self.marks: dict[str, bytes | None] = {}

    def _marks(self, marks: str) -> bytes | None:
        """Ids of marks after a word; None if the word would not be cut from them."""
        if marks not in self.marks:
            if len(self.marks) >= KINDS:
                self.marks.clear()
            ids = self.encode(marks)
            self.marks[marks] = ids if self.encode(f"word{marks}") == self.encode("word") + ids else None
        return self.marks[marks]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(piece)) is None:
            out = self._ids(piece)
        self[piece] = out
        return out

    def _ids(self, piece: str) -> bytes:
        if self.folds and piece.isascii() and not piece.islower() and (low := piece.lower()) != piece:
            return self[low]
        if piece.isalpha() and (not self.folds or piece.lower() == piece) and (piece.isascii() or (max(piece) <= _LATIN and unicodedata.is_normalized("NFC", piece))):
            return self.word(self.prefix + piece)
        stem = piece.rstrip(_MARKS)
        if stem != piece and stem.isalpha() and stem.lower().isalpha() and (marks := self._marks(piece[len(stem) :])) is not None:
            return self[stem] + marks
        if not self.drops and (not piece or _IRREGULAR.search(piece)):
            raise _Irregular
        return self.encode(self.prefix + piece) if piece or self.prefix else b""


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encoded(tokenizer: Tokenizer, text: str) -> bytes:
    return _packed(tokenizer.encode(text, add_special_tokens=False).ids)


def _word(model, letters: dict[int, str], word: str) -> bytes:
    """Ids of letters, with a space before them or not, by the tokenizer's model alone."""
    if word.isascii():  # of these only the space has a stand-in
        shown = word if word.isalpha() else letters[32] + word[1:]
    else:
        shown = "".join(map(letters.__getitem__, word.encode()))
    return _packed([t.id for t in model.tokenize(shown)])


class Encoder:
    """ids(text) as bytes for one tokenizer file; ``path`` is a parameter and never copied."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the caches hold the tokenizer, not this object: without a cycle they go with their task, not when the collector runs
        self._bytes, word = partial(_encoded, self.tokenizer), partial(_word, self.tokenizer.model, _byte_letters())
        #: Whether the pre-tokens drop white space; else a space belongs to the word after it.
        self.drops = self.encode_whole(" ").size == 0
        folds = self._bytes("Word") == self._bytes("word")
        # a pre-token of letters goes straight to the tokenizer's model, where that gives the same ids
        samples = [p + w for p in ([""] if self.drops else ["", " "]) for w in ("word", "thtionable", "überé", "ñandú")]
        word = word if all(word(x) == self._bytes(x) for x in samples) else self._bytes
        self.spaced = _Cache(self._bytes, word, " ", folds, self.drops)
        self.plain = _Cache(self._bytes, word, "", folds, self.drops)
        self.newline = self._bytes("\n")

    def encode_whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._bytes(text), "<u4")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._bytes(text)
        if self.drops:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        try:
            return self._pieces(text)
        except _Irregular:
            return self._bytes(text)

    def _pieces(self, text: str) -> bytes:
        """From single spaces and line ends as cuts. Neighbouring ones leave an empty piece; what else is irregular is in a piece, and met before any cache has it."""
        out = []
        for line in text.split("\n"):
            if out:
                out.append(self.newline)
            first, *rest = line.split(" ")
            out.append(self.plain[first])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out)
