"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, and each segment has a table from its
value to the codes that have it. For a query the search looks up all values at
segment distance 0, then 1, 2, ... from its own segments. Once distance s is
done for all m segments, every code within m * (s + 1) - 1 has been met, so the
search ends as soon as the k-th verified distance is at most that.

Codes are dealt out in blocks, and each block is indexed once, in a file of the
shared folder. A task holds a bounded number of queries and takes one index
after another; what it has found so far bounds the search in the next. Vectors
with equal codes are one entry: of them only the k + 1 smallest ids can be among
the results, so a code that a third of all rows have costs no more than another.
"""

from __future__ import annotations

import functools
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import files_of, new_folder, partitions, put_file, quoted, written

SEGMENT_BITS, WORD_BITS = 16, 64
#: Codes in an index, and queries of a task, at most; there are at least as many tasks as keep all cores busy.
BLOCK_CODES, BLOCK_QUERIES = 1 << 18, 1 << 16


@functools.lru_cache(maxsize=64)
def masks(bits: int, distance: int) -> np.ndarray:
    """All values of ``bits`` bits with ``distance`` of them set."""
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(bits), distance)], np.int64)


class MultiIndex:
    """``codes``: distinct rows of 64-bit words; a flat array has one word each."""

    def __init__(self, codes: np.ndarray, orders: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.codes = codes.reshape(len(codes), -1)
        self.segments = self.codes.shape[1] * WORD_BITS // SEGMENT_BITS
        if orders is None:
            own = self._segments(self.codes)
            orders = np.argsort(own, axis=1, kind="stable").astype(np.uint32)
            starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 << SEGMENT_BITS))]) for x in own]).astype(np.uint32)
        self.orders, self.starts = orders, starts

    @staticmethod
    def _segments(codes: np.ndarray) -> np.ndarray:
        """A row for each segment, a column for each code."""
        return np.ascontiguousarray(codes).view(f"<u{SEGMENT_BITS // 8}").T.astype(np.int64)

    def search(self, code: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes, from near to far, until ``enough(places, distances, bound)``, which gets those up to the bound that is covered."""
        code = np.atleast_1d(code)
        own = self._segments(code[None])[:, 0]
        met, order, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            found = [met]
            for s in range(self.segments):
                value = own[s] ^ masks(SEGMENT_BITS, radius)
                first = self.starts[s][value].astype(np.int64)
                size = self.starts[s][value + 1].astype(np.int64) - first
                hit = size > 0
                first, size = first[hit], size[hit]
                if len(size):
                    ends = np.cumsum(size)
                    found.append(self.orders[s][np.repeat(first - ends + size, size) + np.arange(ends[-1])].astype(np.int64))
            met = np.unique(np.concatenate(found))
            far = np.bitwise_count(self.codes[met] ^ code).sum(axis=1, dtype=np.int64)
            order = np.argsort(far, kind="stable")
            bound = self.segments * (radius + 1) - 1
            covered = order[far[order] <= bound]
            if len(met) == len(self.codes) or enough(met[covered], far[covered], bound):
                break
        return met[order], far[order]


def _code(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Sign bits of vectors: bit i is set where component i is above 0 (a missing one is not)."""
    for batch in batches:
        vectors = batch["vector"]
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        above = pa.compute.fill_null(pa.compute.greater(vectors.flatten(), 0), False).to_numpy(zero_copy_only=False)
        bits = np.zeros((batch.num_rows, words * WORD_BITS), bool)
        first = np.cumsum(sizes) - sizes
        bits[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(above)) - np.repeat(first, sizes)] = above
        out = np.packbits(bits, axis=1, bitorder="little")
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x.tobytes() for x in out], pa.binary())], names=["id", "code"])


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("vector")).dropna(subset=["id", "vector"])


def sign_codes(vectors: DataFrame, words: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code) of vectors; a code is ``words`` little-endian 64-bit words. Rows without id or vector have no code."""
    return _vectors(vectors, id_col, vector_col).mapInArrow(functools.partial(_code, words=words), "id long, code binary")


def _as_words(codes: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<u8").reshape(-1, words)


def _index(entries: pa.Table, folder: str, words: int) -> pa.Table:
    """One block as a file: its index, and the ids of each of its codes."""
    block, ids, out = entries["block"][0].as_py(), entries["ids"].combine_chunks(), io.BytesIO()
    index = MultiIndex(_as_words(entries["code"].to_pylist(), words))
    np.savez(out, codes=index.codes, orders=index.orders, starts=index.starts, ids=ids.flatten().to_numpy(), first=np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]))
    put_file(folder + f"/{block}", "index", out.getvalue())
    return pa.table({"block": pa.array([block], pa.int64())})


def _search(batches: Iterator[pa.RecordBatch], folder: str, blocks: list[int], k: int, words: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of all blocks for the queries of a partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    queries, codes = rows["id"].to_pylist(), _as_words(rows["code"].to_pylist(), words)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    for block in blocks:
        kept = np.load(io.BytesIO(files_of(f"{folder}/{block}")["index"]))
        index, ids, first = MultiIndex(kept["codes"], kept["orders"], kept["starts"]), kept["ids"], kept["first"]
        many = np.diff(first)
        for n, (query, code) in enumerate(zip(queries, codes, strict=True)):
            worst = best[n][k - 1][0] if len(best[n]) >= k else None
            # one more than k, as the query itself may be among them; none farther than the k-th so far can come in
            places, far = index.search(code, lambda at, _, bound, worst=worst: many[at].sum() >= k + 1 or (worst is not None and bound >= worst))
            met: list[tuple[int, int]] = []
            for d, group in itertools.groupby(zip(far.tolist(), places.tolist(), strict=True), key=lambda x: x[0]):
                if len(met) >= k or (worst is not None and d > worst):
                    break
                met += ((d, i) for _, at in group for i in ids[first[at] : first[at + 1]].tolist() if i != query)
            if met:
                best[n] = sorted({*best[n], *met})[:k]
    out = [(query, rank + 1, i, d) for query, own in zip(queries, best, strict=True) for rank, (d, i) in enumerate(own)]
    names = ["query_id", "rank", "vec_id", "distance"]
    for at in range(0, len(out), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at : at + 100_000], strict=True)], names=names)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest of ``vectors`` for each of ``queries``: query_id, rank (from 1), vec_id, distance.

    Distance is the number of differing sign bits; of equal distances smaller
    ids come first. A vector isn't its own neighbour. Rows with the same id and
    code are one, and an id has one code: of several the least; rows without id
    or vector are neither queries nor results. Shorter vectors count as closed
    by missing components, which have no bit. Fewer than k others give fewer rows.
    """
    spark = vectors.sparkSession
    sizes = [_vectors(x, id_col, vector_col).agg(F.max(F.size("vector"))).first()[0] or 1 for x in (vectors, queries)]
    words = max(1, -(-max(sizes) // WORD_BITS))
    codes = sign_codes(vectors, words, id_col, vector_col).groupBy("id").agg(F.min("code").alias("code"))
    ranked = codes.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = written(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "op9-codes")
    asked = written(sign_codes(queries, words, id_col, vector_col).groupBy("id").agg(F.min("code").alias("code")), "op9-queries", narrow=True)
    n_codes, total = max(1, -(-entries.count() // block_codes)), asked.count()
    folder = new_folder(spark, "op9-index")

    def index(own: pa.Table) -> pa.Table:
        return _index(own, folder, words)

    blocks = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(n_codes))).groupBy("block").applyInArrow(index, "block long").collect()
    n_queries = max(1, -(-total // block_queries), min(total, partitions(spark)))
    search = functools.partial(_search, folder=folder, blocks=sorted(b["block"] for b in blocks), k=k, words=words)
    return asked.repartition(n_queries, "id").mapInArrow(search, "query_id long, rank long, vec_id long, distance long")
