"""Whole texts to token ids with the tokenizers library, each distinct word encoded once.

A text is split at ASCII white space, where the pre-tokenizers of the two
vocabularies always split too, so the ids of a text are those of its words in
a row. Words that a worker has met before come from a bounded table; new ones
go through the library, many in a call. Texts with other white space, which
would join across such a split, go through the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Words held in a worker's table before it starts afresh, and the longest word that is held: some 150 MB.
HELD_WORDS, HELD_CHARS = 1_000_000, 40
#: Words of a text that are looked up between two looks at the size of the table.
STEP_WORDS = 100_000
_CHUNKS = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)")
#: White space other than single blanks and single line ends between words.
_UNEVEN = ("  ", " \n", "\n\n", "\n ", "\t", "\v", "\f", "\r")
#: White space that only Unicode, or only Python, takes for such.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_sign(byte: int) -> str:
    """The printable sign by which byte-level vocabularies write a byte: itself, or one of those from 256 on."""
    own = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
    return chr(byte) if own(byte) else chr(256 + sum(not own(b) for b in range(byte)))


class Encoder(dict):
    """Ids by key of a word, learned as words are first met.

    ``keeps_space``: blanks belong to the words after them (byte level), else
    they are dropped, words are lower-cased, and a word is its own key. With
    blanks a key stands for the word with a blank before it; a key that begins
    with a line end stands for itself, and one that begins with a carriage
    return for what follows that.
    """

    def __init__(self, path: str, keeps_space: bool):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenize = self.library.model.tokenize
        self.keeps_space = keeps_space
        self.shown = {i: "".join(_byte_sign(b) for b in chr(i).encode()) for i in range(0x250)}
        self.blank = _byte_sign(32) if keeps_space else ""
        self.signs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _single(self, shown: str) -> bytes:
        """Ids of one pre-token, a run of letters or of signs as the vocabulary writes it, straight from the model."""
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        """Most words are a run of letters, perhaps with signs behind it: two pre-tokens."""
        word, blank, before = key, self.blank, ""
        if self.keeps_space and key[:1] in ("\n", "\r"):
            word, blank, before = key[1:], "", key[0].strip("\r")
        if m := _WORD.fullmatch(word):
            letters, tail = m.groups()
            out = self.get(own := letters if blank == self.blank else "\r" + letters) if tail or before else None
            if out is None:
                shown = letters if self.keeps_space else letters.lower()
                out = self._single(blank + (shown if shown.isascii() else shown.translate(self.shown)))
                if tail and len(own) <= HELD_CHARS:
                    self[own] = out
            if before:
                out = self._sign(before) + out
            if tail:
                out += self._sign(tail)
        else:
            out = self.whole((" " if blank else before) + word)
        if len(key) <= HELD_CHARS:
            self[key] = out
        return out

    def _sign(self, signs: str) -> bytes:
        """Ids of a run of ASCII signs, or of a line end, of which there are few."""
        out = self.signs.get(signs)
        if out is None:
            out = self.whole(signs) if signs == "\n" else self._single(signs)
            if len(signs) < 4:
                self.signs[signs] = out
        return out

    def _keys(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.split()
        if not any(x in text for x in _UNEVEN):
            return ("\r" + text.replace("\n", " \n")).split(" ")
        return [c[1:] if c[0] == " " and c[1:2] not in ("\n", "\r") else c if c[0] == "\n" else "\r" + c for c in _CHUNKS.findall(text)]

    def _text(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        keys, out = self._keys(text), []
        for at in range(0, len(keys), STEP_WORDS):
            if len(self) > HELD_WORDS:
                self.clear()
            out.append(b"".join(map(self.__getitem__, keys[at : at + STEP_WORDS])))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is empty."""
        return [self._text(t) if t else b"" for t in texts]


@functools.lru_cache(maxsize=1)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """A worker's own encoder, for functions that hold it by ``shared.holding(forget)``."""
    return Encoder(path, keeps_space)


def forget() -> None:
    encoder.cache_clear()


def narrow(raw: bytes) -> bytes:
    """32-bit ids as 16-bit ones. Raises for an id that these don't hold."""
    ids = np.frombuffer(raw, "<u4")
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} needs more than 16 bits")
    return ids.astype("<u2").tobytes()
