"""SentencePiece segmentations sampled from the piece lattice, and their lossless decoding.

A segmentation of a text has the probability that is proportional to the
product of its pieces' weights, exp(score / temperature). It is drawn by
forward filtering, which sums the weights of all ways to reach each position,
and backward sampling, which walks from the end and draws each piece by its
share. No piece of the vocabulary goes on behind a letter with another sign, or
behind any sign with a blank (checked when it is loaded), so a text falls into
units that are drawn one by one. The lattices of all distinct units of a batch
are built and filtered together, and all their occurrences sampled together.

Every draw is a hash of the seed, the row's key, the unit's place in the text
and the step, so a row has the same pieces wherever and whenever it is encoded.

Characters that are no piece become byte pieces, and so does the sign by which
pieces write a blank, if a text has it; nothing is normalised. A blank is put
before the text and taken off again, so decoding gives back the very text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import holding, text_batches
from plumbline.llm.shingles import mixed

BLANK = "▁"
TEMPERATURE = 4096.0
#: Characters of a batch.
BATCH_CHARS = 1_500_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNITS = re.compile(f" *[^ {_LETTERS}]*[{_LETTERS}]+| *[^ {_LETTERS}]+| +")
_CROSSES = re.compile(f"[{_LETTERS}][^{_LETTERS}]|[^ ] ")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SLOTS = 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


class Pieces:
    """The vocabulary of a model, as byte strings for decoding and as a hash table for the lattice."""

    def __init__(self, path: str, temperature: float = TEMPERATURE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.raw = [b""] * self.size
        self.byte_ids = np.zeros(256, np.int64)
        texts, ids, scores = [], [], []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                text = piece.replace(BLANK, " ")
                self.raw[i] = text.encode()
                texts.append(text)
                ids.append(i)
                scores.append(model.get_score(i))
        if crossing := [t for t in texts if _CROSSES.search(t)]:
            raise ValueError(f"pieces that cross units: {crossing[:5]}")
        scores = np.array(scores)
        scores[scores < -1e6] = 0.0  # pieces that a user has set have no score of their own
        self.weights = scores / temperature
        self.byte_weight = float(self.weights.min()) - 1.0
        self.ids, self.longest = np.array(ids, np.int64), max(map(len, texts))
        self._fill(texts)

    def _fill(self, texts: list[str]) -> None:
        flat, ends = self._codes(texts), np.cumsum([len(t) for t in texts])
        sums = self._sums(flat)
        starts = np.concatenate([[0], ends[:-1]])
        self.hashes = self._hash(sums, starts, ends, _powers(_INVERSE, len(flat)))
        if len(np.unique(self.hashes)) < len(texts):
            raise ValueError("two pieces have one hash")
        self.tables, left, shift = [], np.arange(len(texts)), 64 - _SLOTS
        while len(left):  # what collides goes to a further table, by other bits
            table, slot = np.full(1 << _SLOTS, -1, np.int32), self._slot(self.hashes[left], shift)
            table[slot] = left
            self.tables.append((table, shift))
            left, shift = left[table[slot] != left], shift - 9

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")

    @staticmethod
    def _sums(flat: np.ndarray) -> np.ndarray:
        values = mixed(flat.astype(np.uint64) + np.uint64(1))
        return np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(_BASE, len(flat))[:-1], dtype=np.uint64)])

    @staticmethod
    def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * inverse[starts])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the piece with each hash, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for table, shift in self.tables:  # only where another piece has the slot can the piece be in the next table
            row = table[self._slot(hashes[left], shift)]
            left, row = left[row >= 0], row[row >= 0]
            hit = self.hashes[row] == hashes[left]
            out[left[hit]] = row[hit]
            left = left[~hit]
        return out

    def lattice(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """(first edge, end node, start node by unit; share up to and with each edge, its id, its start node).

        Edges are the pieces that fit, by the node where they end. An id from
        ``size`` on stands for the bytes of the character behind it.
        """
        sizes = np.array([len(u) for u in units], np.int64)
        flat = self._codes(units)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        unit = np.repeat(np.arange(len(units)), sizes)
        offset = np.arange(len(flat)) - first[unit]
        room = sizes[unit] - offset
        sums, inverse = self._sums(flat), _powers(_INVERSE, len(flat))
        starts, lengths, ids, weights = [], [], [], []
        for n in range(1, min(self.longest, int(sizes.max(initial=0))) + 1):
            at = np.flatnonzero(room >= n)
            row = self.find(self._hash(sums, at, at + n, inverse))
            hit = row >= 0
            if n == 1 and not hit.all():  # no piece: its bytes
                alone = at[~hit]
                starts.append(alone)
                lengths.append(np.ones(len(alone), np.int64))
                ids.append(flat[alone].astype(np.int64) + self.size)
                weights.append(np.full(len(alone), self.byte_weight))
            at, row = at[hit], row[hit]
            starts.append(at)
            lengths.append(np.full(len(at), n))
            ids.append(self.ids[row])
            weights.append(self.weights[row])
        start, length, ids, weight = map(np.concatenate, (starts, lengths, ids, weights))
        source = start + unit[start]  # a unit has a node more than characters
        target, depth = source + length, offset[start] + length
        nodes = len(flat) + len(units)
        order = np.argsort(depth * nodes + target, kind="stable")
        source, target, depth, ids, weight = (x[order] for x in (source, target, depth, ids, weight))
        mass, share, ptr = np.zeros(nodes), np.empty(len(ids)), np.zeros(nodes, np.int64)
        cuts = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, value = target[a:b], mass[source[a:b]] + weight[a:b]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(value, head)
            grown = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(grown, head)
            run = np.cumsum(grown)
            base = run[head] - grown[head]
            share[a:b] = (run - np.repeat(base, many)) / np.repeat(total, many)
            share[a + head + many - 1] = 2.0  # the last one takes what rounding leaves
            mass[own[head]], ptr[own[head]] = top + np.log(total), a + head
        begin = first + np.arange(len(units))
        return ptr, begin + sizes, begin, share, ids, source

    def sample(self, texts: list[str | None], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """For each text the ids of a segmentation drawn for its key (uint64)."""
        units = [_UNITS.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(u) for u in units], np.int64)
        every = [u for own in units for u in own]
        if not every:
            return [np.zeros(0, np.int64)] * len(texts)
        distinct = list(set(every))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        which = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        ptr, end, begin, share, ids, source = self.lattice(distinct)
        doc = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(every)) - np.concatenate([[0], np.cumsum(counts)])[:-1][doc]
        draw = mixed(mixed(keys ^ mixed(np.uint64([seed])))[doc] + place.astype(np.uint64) * _BASE)
        node, stop, active, step = end[which], begin[which], np.arange(len(every)), 0
        pieces = np.zeros(len(every), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            u = (mixed(draw[active] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            at, late = ptr[node], np.arange(len(active))
            while len(late := late[u[late] >= share[at[late]]]):
                at[late] += 1
            found.append((active, ids[at]))
            pieces[active] += 1
            node = source[at]
            go = node != stop[active]
            active, node, step = active[go], node[go], step + 1
        after = np.cumsum(pieces)
        out = np.empty(int(after[-1]), np.int64)
        for step, (occurrence, own) in enumerate(found):  # drawn from the end, so laid down from the end
            out[after[occurrence] - 1 - step] = own
        ends = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])]
        return [self._spelt(out[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids) or ids.max() < self.size:
            return ids
        short = (ids >= self.size) & (ids < self.size + 128)
        ids = ids.copy()
        ids[short] = self.byte_ids[ids[short] - self.size]
        if ids.max() < self.size:
            return ids
        return np.array([x for i in ids.tolist() for x in ((i,) if i < self.size else self.byte_ids[list(chr(i - self.size).encode())].tolist())], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode().removeprefix(" ")


@functools.lru_cache(maxsize=1)
def pieces_of(path: str, temperature: float) -> Pieces:
    return Pieces(path, temperature)


def forget() -> None:
    pieces_of.cache_clear()


@holding(forget)
def _encode(batches: Iterator[pa.RecordBatch], path: str, temperature: float, seed: int) -> Iterator[pa.RecordBatch]:
    own = pieces_of(path, temperature)
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch["text"].to_pylist()])
        groups = np.cumsum(sizes) // BATCH_CHARS
        cuts = [*np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])).tolist(), batch.num_rows] if len(sizes) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(a, b - a)
            keys = rows["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            ids = [x.astype("<u4").tobytes() for x in own.sample(rows["text"].to_pylist(), keys, seed)]
            yield pa.RecordBatch.from_arrays([rows["id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])


@holding(forget)
def _decode(batches: Iterator[pa.RecordBatch], path: str, temperature: float) -> Iterator[pa.RecordBatch]:
    own = pieces_of(path, temperature)
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            rows = batch.slice(i, 1024)
            texts = [own.decode(np.frombuffer(x, "<u4")) for x in rows["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["ids"], pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def sample_pieces(docs: DataFrame, model: str, temperature: float = TEMPERATURE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of a sampled segmentation of every text.

    The id is the key of the draw; rows with the same id and text so have the
    same pieces, a null id is a key like others. A null or empty text has none.
    A low temperature gives the best segmentation, a high one any.
    """
    text_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("none"))).alias("key")
    rows = docs.select(F.col(id_col).alias("id"), key, F.col(text_col).alias("text"))
    encode = functools.partial(_encode, path=model, temperature=temperature, seed=seed)
    return rows.mapInArrow(encode, f"doc_id {rows.schema['id'].dataType.simpleString()}, ids binary")


def decode_pieces(encoded: DataFrame, model: str, temperature: float = TEMPERATURE) -> DataFrame:
    """``encoded`` with the text that its ids spell: that which was encoded, and the empty text for no ids. Repeated rows stay."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string"
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decode, path=model, temperature=temperature), schema)
