"""Exact token ids of whole texts, with a bounded memo of what the tokenizers library returns.

A tokenizer's pre-tokenizer cuts a text before its merges run, so a text may be cut at any
place that is certainly such a boundary, and each piece encoded alone. Pieces repeat, and a
repeated piece is looked up instead of encoded again. The ids always come from the library.

* Word BPE (white space dropped): every blank and line feed separates words for certain.
* Byte-level BPE (blanks kept): a blank after a non-space starts a new pre-token; so does a
  blank that follows white space and stands before a non-space. Texts in which a blank
  stands inside a run of white space are cut only after non-spaces, texts that hold a
  special string are encoded whole.
* A new piece of Latin letters is a pre-token by itself, so it goes to the library's BPE
  model directly, which is several times faster than a whole encoding of so short a text.
"""

from __future__ import annotations

import os
import re
from array import array

from vectorloom.llm.worker import kept

#: Pieces remembered per Python worker (about 100 MB); further pieces are encoded each time.
MEMO_ENTRIES = 400_000

INNER_BLANK = re.compile(r"\s (?:\s|\Z)")
AFTER_NON_SPACE = re.compile(r"(?<=\S)(?= )")

#: Letters that every Unicode version knows, and that NFC and per-letter lower case keep single.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+"
WORDS = re.compile(rf"({LETTERS})([.,;:!?]*)(?:(\n)({LETTERS})([.,;:!?]*))?")
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {byte: chr(byte) for byte in plain}
    for byte in range(256):
        if byte not in table:
            table[byte] = chr(256 + len(table) - len(plain))
    return table


class _Memo(dict):
    """piece -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, owner: "Encoder", prefix: str = ""):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii():  # what most pieces are, without the pattern
            if piece.isalpha():
                packed = self.owner.word(self.prefix + piece)
                if len(self) < MEMO_ENTRIES:
                    self[piece] = packed
                return packed
            if piece[-1:] in MARKS and piece[:-1].isalpha():
                return self[piece[:-1]] + self.owner.pieces[piece[-1]]
        found = WORDS.fullmatch(piece)
        if found is None:
            packed = self.owner.by_library(self.prefix + piece)
        elif found.end(1) == len(piece):
            packed = self.owner.word(self.prefix + piece)
        elif found[3] is None:  # words and marks are remembered, not each of their combinations
            return self[found[1]] + self.owner.pieces[found[2]]
        else:
            rest = [part for part in found.groups()[1:] if part]
            return self[found[1]] + b"".join(map(self.owner.pieces.__getitem__, rest))
        if len(self) < MEMO_ENTRIES:
            self[piece] = packed
        return packed


class Encoder:
    """Token ids of a text as packed bytes, equal to the library's for the whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_space = bool(self.model.end_of_word_suffix)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.pieces = _Memo(self)
        self.after_blank = _Memo(self, " ")

    def by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if self.drops_space:
            word = word.lower()
        if word.isascii():  # letters stand for themselves, so only the blank is written otherwise
            spelled = word.replace(" ", self.letters[32])
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            pieces = text.replace("\n", " ").split(" ")
            return b"".join(map(self.pieces.__getitem__, pieces))
        if any(special in text for special in self.special):
            return self.by_library(text)
        if INNER_BLANK.search(text):
            return b"".join(map(self.pieces.__getitem__, AFTER_NON_SPACE.split(text)))
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.after_blank.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the Python worker."""
    return kept(("encoder", path), lambda: Encoder(path))
