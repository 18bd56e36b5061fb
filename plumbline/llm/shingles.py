"""Word shingles of whole texts as 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: Hash functions of a signature.
HASHES = 128
HELD_WORDS = 400_000
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def forget() -> None:
    _words.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result hangs on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted; A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    words = text.encode().lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > HELD_WORDS:
        _words.clear()
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(own) < WORDS:
        return mixed((own * _FACTORS[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))
    n = len(own) - WORDS + 1
    whole = own[:n] * _FACTORS[0]
    for i in range(1, WORDS):
        whole += own[i : i + n] * _FACTORS[i]
    return np.unique(mixed(whole))


def signature(own: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the minimum of each hash function over the shingles of one text (at least one)."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(own), 512):
        np.minimum(least, (own[at : at + 512, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)
