"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Each partition (a sender) hashes its normalised texts, sorts the distinct
   fingerprints, keeps them Golomb-coded in a file of the shared folder and
   sends each owner of a hash range its part of them.
2. An owner merges what it gets and answers each sender with a bitmap of the
   fingerprints that another sender has too. Answers are a file per sender.
3. The senders read their rows a second time and apply their own bitmaps: a row
   that occurs once is done, with no shuffle. Only suspects (by bitmap, or twice
   in one partition) are shuffled, whole, and compared byte by byte.

What travels for a text that occurs once is a few bytes of its fingerprint.
Copies inside one partition are folded before anything is sent, and the byte
comparison aggregates before its shuffle, so a group with a third of all rows
costs each partition one row there.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import golomb
from plumbline.llm.shared import drop_rows, files_of, holding, mapped, new_folder, normalised, partitions, put_file, quoted, text_batches, written

#: Bits of a fingerprint, taken from the front of the SHA-256 of the text.
FINGERPRINT_BITS = 48
#: A sender sends what it holds after so many rows, so its memory is bounded.
SENDER_ROWS = 1_000_000


def _fronts(sha: pa.Array) -> np.ndarray:
    """The fingerprints of hashes of 32 bytes each, none of them null."""
    if not len(sha):
        return np.zeros(0, np.uint64)
    whole = np.frombuffer(b"".join(sha.to_pylist()), ">u8")
    return (whole[::4] >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint64)


def _send(batches: Iterator[pa.RecordBatch], folder: str, owner_bits: int) -> Iterator[pa.RecordBatch]:
    """(part, number, owner, run) of each run that an owner gets; what was sent, and which of it is there twice, stays in a file."""
    part = TaskContext.get().partitionId()

    def flush(held: list[np.ndarray], number: int) -> pa.RecordBatch:
        distinct, count = np.unique(np.concatenate(held), return_counts=True)
        owner = (distinct >> np.uint64(FINGERPRINT_BITS - owner_bits)).astype(np.int64)
        owners, first = np.unique(owner, return_index=True)
        base = np.append(first, len(distinct))
        runs = [golomb.encode(distinct[a:b] - (np.uint64(o) << np.uint64(FINGERPRINT_BITS - owner_bits))) for o, a, b in zip(owners.tolist(), base, base[1:], strict=False)]
        out = io.BytesIO()
        np.savez(out, run=np.frombuffer(golomb.encode(distinct), np.uint8), twice=np.packbits(count > 1), owners=owners, base=base)
        put_file(f"{folder}/sent/{part}", str(number), out.getvalue())
        m = len(owners)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, part), pa.int32()), pa.array(np.full(m, number), pa.int32()), pa.array(owners, pa.int32()), pa.array(runs, pa.binary())], names=["part", "number", "owner", "run"])

    held, rows, number = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(_fronts(batch["sha"]))
            rows += batch.num_rows
        if rows >= SENDER_ROWS:
            yield flush(held, number)
            held, rows, number = [], 0, number + 1
    if rows:
        yield flush(held, number)


def _own(runs: pa.Table) -> pa.Table:
    """All runs of one owner: for each sender the bitmap of fingerprints that another has sent too."""
    decoded = [golomb.decode(x) for x in runs["run"].to_pylist()]
    distinct, count = np.unique(np.concatenate(decoded), return_counts=True)
    bitmaps = [np.packbits(count[np.searchsorted(distinct, values)] > 1).tobytes() for values in decoded]
    return pa.table({"part": runs["part"], "number": runs["number"], "owner": runs["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def _answer(bitmaps: pa.Table, folder: str) -> pa.Table:
    """All bitmaps of one sender, as a file for its second reading."""
    part = bitmaps["part"][0].as_py()
    out = io.BytesIO()
    with pa.ipc.new_file(out, bitmaps.schema) as writer:
        writer.write_table(bitmaps)
    put_file(f"{folder}/answers/{part}", "bitmaps", out.getvalue())
    return pa.table({"part": pa.array([part], pa.int32())})


@functools.lru_cache(maxsize=2)
def _singles(folder: str, part: int) -> np.ndarray:
    """The fingerprints, sorted, that a sender's partition had once and that no other had."""
    answers = {}
    for data in files_of(f"{folder}/answers/{part}").values():
        rows = pa.ipc.open_file(data).read_all()
        answers = {(n, o): b for n, o, b in zip(*(rows[c].to_pylist() for c in ("number", "owner", "bitmap")), strict=True)}
    found = []
    for number, data in files_of(f"{folder}/sent/{part}").items():
        kept = np.load(io.BytesIO(data))
        values = golomb.decode(kept["run"].tobytes()).astype(np.uint64)
        again = np.unpackbits(kept["twice"], count=len(values)).astype(bool)
        for o, a, b in zip(kept["owners"].tolist(), kept["base"], kept["base"][1:], strict=False):
            own = answers.get((int(number), o))
            again[a:b] |= np.unpackbits(np.frombuffer(own, np.uint8), count=b - a).astype(bool) if own is not None else True
        found.append(values[~again])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@holding(_singles.cache_clear)
def _apply(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The rows, numbered, with ``suspect``; texts of suspects only. A fingerprint that this partition hasn't sent is a suspect too."""
    part, row = TaskContext.get().partitionId(), 0
    singles = _singles(folder, part)
    for batch in batches:
        n, fronts = batch.num_rows, _fronts(batch["sha"])
        at = np.minimum(np.searchsorted(singles, fronts), max(0, len(singles) - 1))
        suspect = pa.array(singles[at] != fronts if len(singles) else np.ones(n, bool))
        norm = pa.compute.if_else(suspect, batch["norm"], pa.scalar(None, batch.schema.field("norm").type))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["sha"], norm, suspect, pa.array((part << 40) + row + np.arange(n))], names=["id", "sha", "norm", "suspect", "at"])
        row += n


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts that are identical once runs of ASCII white space are one
    blank; null is the empty text, and empty texts equal each other. Of a group
    the smallest id stays, a null id only where the group has no other; of rows
    repeated with the same id and text exactly one is kept. An empty table gives
    an empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    owner_bits = max(1, ((owners or 2 * partitions(spark)) - 1).bit_length())
    rows = docs.select(F.col(quoted(id_col)).alias("id"), normalised(text_col).alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm"), 256)))
    kind, folder = rows.schema["id"].dataType.simpleString(), new_folder(spark, "op1")

    runs = rows.select("sha").mapInArrow(functools.partial(_send, folder=folder, owner_bits=owner_bits), "part int, number int, owner int, run binary")
    bitmaps = runs.groupBy("owner").applyInArrow(_own, "part int, number int, owner int, bitmap binary")

    def answer(own: pa.Table) -> pa.Table:
        return _answer(own, folder)

    bitmaps.groupBy("part").applyInArrow(answer, "part int").agg(F.count(F.lit(1))).first()

    # the second reading; only suspects keep their texts
    schema = f"id {kind}, sha binary, norm string, suspect boolean, at long"
    told = mapped(rows.select("id", "norm", "sha"), functools.partial(_apply, folder=folder), schema, "op1-rows")
    suspects = told.where("suspect")
    # numbers alone are aggregated beside the texts, so that these are hashed, not sorted
    groups = (
        suspects.groupBy("sha", "norm")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id"))
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("keep_id").alias("keep_id"))
        .select("sha", "keep_id", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("texts of one hash differ in their bytes"))).alias("group_size"))
    )
    groups = written(groups, "op1-groups", narrow=True)  # so that the joins below, by a key that may be hot, deal out both their sides
    first = suspects.select("id", "sha", "at").join(groups, "sha").where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("at").alias("keep_at"), F.first("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    groups = written(first, "op1-kept", narrow=True)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    once = told.where("not suspect").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    more = suspects.select("id", "sha", "at").join(groups, "sha").select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), sha)
    return once.unionByName(more)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` doesn't keep, with the columns it came with.

    Rows are told apart by id and text; of rows that agree in both, one stays.
    """
    found = exact_duplicates(docs, id_col, text_col).where("group_size > 1")
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key")).agg(F.max("kept").alias("kept"), F.min("kept").alias("all")).where("not all")
    return drop_rows(docs, F.sha2(normalised(text_col), 256), marks, id_col)
