"""Best-fit packing of token sequences by minimum bin slack.

The lengths of all pieces make a histogram with one bar per length, however
many documents there are. On it the driver solves the packing, bin by bin: the
longest length left must be in, and a subset-sum over the other lengths, as a
bitset of reachable sums, finds the fullest feasible rest. That pattern is taken
as often as the histogram has it, and removed. Each piece then finds its place
by its rank among the pieces of its length, without a shuffle: it has a local
rank in its partition, and ranks of earlier partitions are a sum by length.
"""

from __future__ import annotations

import functools
import io
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.encoder import encoder, forget
from plumbline.llm.shared import files_of, holding, mapped, new_folder, put_file, text_batches, written

CAPACITY = 2048
BATCH_ROWS = 128


class Place(NamedTuple):
    """Pieces of a length with ranks from ``first``: ``each`` of them in each of the sequences from ``sequence`` on, side by side from ``offset``."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def fullest(counts: dict[int, int], room: int) -> Counter[int]:
    """The multiset of available lengths with the largest sum up to ``room``; of equal sums one with longer lengths."""
    if room <= 0:
        return Counter()
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Place], int]:
    """Places for all pieces of a histogram of lengths, and the number of sequences."""
    counts = {k: v for k, v in histogram.items() if v}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    used: Counter[int] = Counter()
    places, sequences = [], 0
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        pattern = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        pattern[longest] += 1
        times, offset = min(counts[k] // n for k, n in pattern.items()), 0
        for length, n in sorted(pattern.items(), reverse=True):
            places.append(Place(length, used[length], sequences, n, offset))
            offset += length * n
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequences += times
    return places, sequences


@holding(forget)
def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, keeps_space: bool, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end, part = encoder(tokenizer, keeps_space).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
    ranks: Counter[int] = Counter()
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(i, BATCH_ROWS)
            out: list[tuple] = []
            for doc_id, raw in zip(rows["id"].to_pylist(), encode(rows["text"].to_pylist()), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc_id, piece, at // 4, length, own, part, ranks[length]))
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])


def encode_pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, each text closed by ``end_id``, in the shared folder.

    Only longer texts are cut, and only their last piece is shorter. A null or
    empty text is one piece of one id. ``ids`` are little-endian unsigned 32-bit
    integers; (part, rank) numbers the pieces of a length in a partition.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    encode = functools.partial(_encode, tokenizer=tokenizer, keeps_space=keeps_space, end_id=end_id, capacity=capacity)
    return mapped(rows, encode, "doc_id long, piece int, start long, length long, ids binary, part int, rank long", "op6-pieces")


def _tell(counts: pa.Table, folder: str) -> pa.Table:
    """How many pieces of each length earlier partitions have, as a file for one partition."""
    part, out = counts["part"][0].as_py(), io.BytesIO()
    np.savez(out, length=counts["length"].to_numpy(), before=counts["before"].to_numpy())
    put_file(f"{folder}/{part}", "before", out.getvalue())
    return pa.table({"part": pa.array([part], pa.int32())})


@functools.lru_cache(maxsize=4)
def _before(folder: str, part: int, capacity: int) -> np.ndarray:
    """By length: how many pieces earlier partitions have."""
    out = np.zeros(capacity + 1, np.int64)
    for data in files_of(f"{folder}/{part}").values():
        own = np.load(io.BytesIO(data))
        out[own["length"]] = own["before"]
    return out


@holding(_before.cache_clear)
def _place(batches: Iterator[pa.RecordBatch], folder: str, keys: np.ndarray, places: np.ndarray, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, length = batch["part"].to_numpy(), batch["length"].to_numpy()
        rank = batch["rank"].to_numpy().copy()
        for p in np.unique(part):
            own = part == p
            rank[own] += _before(folder, int(p), capacity)[length[own]]
        found = places[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
        number, at = np.divmod(rank - found[:, 1], found[:, 3])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(found[:, 2] + number), pa.array(found[:, 4] + at * length)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``encode_pieces`` with sequence_id and offset: gapless from 0 in each sequence, in as few as it can.

    The driver sees a count for each length, and the plan that goes to all tasks
    is bounded by the capacity, not by the number of pieces. No piece is moved.
    Equal lengths are taken in order of partition and row; pieces of repeated or
    null ids are pieces like others; no pieces give no sequences.
    """
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "op6-counts", narrow=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    folder = new_folder(pieces.sparkSession, "op6-before")
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def tell(own: pa.Table) -> pa.Table:
        return _tell(own, folder)

    before.groupBy("part").applyInArrow(tell, "part int").agg(F.count(F.lit(1))).first()
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    place = functools.partial(_place, folder=folder, keys=(table[:, 0] << 48) | table[:, 1], places=table, capacity=capacity)
    return pieces.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and all ids, in order of offset. A sequence is bounded by the capacity."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("own"))
        .select("sequence_id", F.aggregate("own.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"), F.aggregate("own.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    )


