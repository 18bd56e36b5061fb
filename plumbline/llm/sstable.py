"""Sorted-string-table shards: token ids of documents, found by binary search.

A shard is a run of data blocks, then a sparse index, a Bloom filter and a
footer. In a block each key is stored as the length it shares with the key
before it and the rest; every 16th is stored whole, and the places of those
close the block, so a lookup bisects them. Blocks are compressed with zstd and
carry a CRC. The index holds the first key of each block.

Keys are 9 bytes that sort as the ids do: a byte 0 for a null id, which so
comes first, else 1 and the id with its sign bit flipped, big-endian. Keys may
repeat.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"PLSST001"
BLOCK_BYTES = 256 * 1024
RESTART = 16
#: Bits of the Bloom filter for each key, and probes: about 1 % false positives.
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: offset and size of index and filter; documents, tokens, bytes of an id.
FOOTER = struct.Struct("<QQQQQQQ8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Takes (id, ids) in ascending order of id, nulls first."""

    def __init__(self, file: BinaryIO, width: int = 2):
        import zstandard

        self.file, self.width = file, width
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.docs = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError(f"{doc_id} comes after a larger id")
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=True)) if x != y), len(key))
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"id {ids.max()} needs more than {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if self.count == 0:
            self.first = key
        self.count, self.last = self.count + 1, key
        self.keys.append(key)
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if not self.count:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.pack(body)
        offset, size = self._put(packed + struct.pack("<I", zlib.crc32(packed)))
        self.index.append(self.first + struct.pack("<QI", offset, size))
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(self.index))
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        filt = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(*index, *filt, self.docs, self.tokens, self.width, MAGIC))


class Reader:
    """``file`` can seek. Only index, filter and footer are held; blocks are read when asked for."""

    def __init__(self, file: BinaryIO):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        end = file.tell() - FOOTER.size
        a, b, c, d, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self._at(end, FOOTER.size)) if end >= 0 else (*[0] * 7, b"")
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        index = self._at(a, b)
        self.first = [index[i : i + 9] for i in range(0, b, 21)]
        self.places = [struct.unpack_from("<QI", index, i + 9) for i in range(0, b, 21)]
        self.bloom, self.bits = self._at(c, d), d * 8

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        raw = self._at(*self.places[i])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        body = self.unpack(raw[:-4])
        n = struct.unpack("<I", body[-4:])[0]
        end = len(body) - 4 - 4 * n
        return body, list(struct.unpack_from(f"<{n}I", body, end)), end

    def _entries(self, body: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, np.frombuffer(body, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            body, _, end = self._block(i)
            for key, ids in self._entries(body, 0, end):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (of repeated ids, the first); None if the shard lacks it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        i = max(0, bisect.bisect_left(self.first, key) - 1)  # repeated keys may begin in the block before
        while i < len(self.first) and self.first[i] <= key:
            body, restarts, end = self._block(i)
            whole = lambda at, body=body: next(self._entries(body, at, end))[0]  # noqa: E731, B023
            j = max(0, bisect.bisect_left(restarts, key, key=whole) - 1)
            for found, ids in self._entries(body, restarts[j], end):
                if found == key:
                    return ids
                if found > key:
                    return None
            i += 1
        return None
