"""Byte-level BPE of whole texts with the ``tokenizers`` library, fast on repeated words.

A byte-level BPE file splits text by a fixed pattern and merges inside each
piece only, so a piece has the same ids wherever it stands.  The library encodes
each distinct piece once; a bounded table in the worker remembers the ids.
Texts that hold a special token's string, or a character for which two Unicode
tables could split differently, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from hashlib import sha256

import numpy as np
import tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The letters and digits of ASCII, Latin-1 and Latin Extended-A.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = " \\t\\n\\r"
#: The vocabulary's public splitting pattern, written for these characters.
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Texts of these characters only are split here: the alphabets above, common dashes and quotation marks.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u017f\u2013\u2014\u2018-\u201d\u2022\u2026]*"
SPLITTER = "1"  # raise it with any change of how texts are split or pieces are encoded here
REMEMBERED = 800_000  # pieces


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 0x100 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """``ids(text)`` as ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = re.compile(PATTERN).findall
        self.plain = re.compile(PLAIN).fullmatch
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else (lambda text: None)
        self.known: dict[str, bytes] = {}
        self.length: dict[str, int] = {}

    def _learn(self, split: list[list[str]], table: dict, value) -> None:
        """Give ``table`` the value of every new piece's ids, from the library's model."""
        if len(table) > REMEMBERED:
            table.clear()
        merge = self.tokenizer.model.tokenize
        for piece in {p for pieces in split for p in pieces if p not in table}:
            letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            table[piece] = value([t.id for t in merge(letters)])

    def _split(self, texts: list[str], table: dict, value):
        """Pieces of each plain text, else None; the library's encodings of the others."""
        split = [
            self.split(t) if self.pieces and self.plain(t) is not None and self.special(t) is None else None for t in texts
        ]
        self._learn([s for s in split if s is not None], table, value)
        others = [t for t, s in zip(texts, split) if s is None]
        return split, iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))

    def ids(self, texts: list[str], size: int = 128):
        """Ids of each text, in order, as an unsigned 32-bit array."""
        for k in range(0, len(texts), size):
            known = self.known
            split, whole = self._split(texts[k : k + size], known, lambda ids: array("I", ids).tobytes())
            for s in split:
                if s is None:
                    yield np.array(next(whole).ids, np.uint32)
                else:
                    yield np.frombuffer(b"".join([known[p] for p in s]), np.uint32)

    def counts(self, texts: list[str], size: int = 128):
        """The number of ids of each text, in order."""
        for k in range(0, len(texts), size):
            length = self.length
            split, whole = self._split(texts[k : k + size], length, len)
            for s in split:
                yield len(next(whole)) if s is None else sum(map(length.__getitem__, s))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """Digest of the vocabulary file, of the library's version and of this module's own splitting."""
    with open(path, "rb") as f:
        return sha256("\0".join([f.read().hex(), "tokenizers", tokenizers.__version__, SPLITTER, PATTERN, PLAIN]).encode()).hexdigest()
