"""Golomb codes (with a power of two as parameter) of sorted, distinct integers.

Quotients and remainders stand in two streams, so that both directions are
vectorised: the unary stream is parsed by looking for its zero bits.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBI")


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values below 2**62; their gaps are coded."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    k = max(0, int(np.floor(np.log2(max(1.0, float(gaps.mean()) * np.log(2))))))
    quotient, rest = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    bits = ((rest[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    return _HEAD.pack(n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k, size = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.int64)
    body = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    cut = (size + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=size) == 0)
    quotient = np.diff(ends, prepend=-1) - 1
    rest = np.zeros(n, np.int64)
    if k:
        bits = np.unpackbits(body[cut:], count=n * k).reshape(n, k).astype(np.int64)
        rest = bits @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotient.astype(np.int64) << k) | rest)
