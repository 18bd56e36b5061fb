"""Token ids of documents as sorted-string-table shards, written and read by range of id."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import sstable
from plumbline.llm.encoder import encoder, forget
from plumbline.llm.shared import holding, new_folder, open_folder, partitions, text_batches

#: Rows handed to the library at a time.
BATCH_ROWS = 256


@holding(forget)
def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, keeps_space: bool, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """One shard for the partition; yields its place in the order, path, documents and tokens."""
    task = TaskContext.get()
    store, root = open_folder(folder)
    name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
    encode, end = encoder(tokenizer, keeps_space).encode, np.array([end_id], "<u4")
    writer = None
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(i, BATCH_ROWS)
            if writer is None:
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{root}/{name}")
                writer = sstable.Writer(file, width)
            for doc_id, raw in zip(part["id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]))
    if writer is not None:
        writer.close()
        file.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{name}"], "docs": [writer.docs], "tokens": [writer.tokens]})


def _by_range(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in ``n`` partitions by range of id, nulls in the first. Bounds come from the ids alone, so texts are read once."""
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], F.lit(max(10_000, 20 * n)))).first()[0] if n > 1 else None
    if not found:
        return rows.repartitionById(n, F.lit(0))
    bounds = sorted(set(found))
    step = math.isqrt(len(bounds)) + 1  # two short searches stand for one over all bounds
    every, coarse = (F.array(*(F.lit(b) for b in x)) for x in (bounds, bounds[::step]))
    before = lambda own: F.size(F.filter(own, lambda b: b < F.col("id")))
    block = before(coarse)
    part = F.when(block > 0, (block - 1) * step + before(F.slice(every, (block - 1) * step + 1, step))).otherwise(0)
    return rows.withColumn("part", F.coalesce(part, F.lit(0))).repartitionById(n, "part").drop("part")


def write_shards(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Writes the shards in the shared folder and returns their list: part, path, docs, tokens.

    Ids ascend through the shards in order of ``part``, null ids first; rows
    that repeat an id stand side by side in order of their text. A null text is
    empty, so its ids are just the end id. An empty table makes no shard. A task
    that is run again writes a file of its own; only those listed count.
    """
    spark = docs.sparkSession
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = _by_range(rows, partitions(spark)).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    write = functools.partial(_write, folder=new_folder(spark, "op4-shards"), tokenizer=tokenizer, keeps_space=keeps_space, end_id=end_id, width=width)
    schema = "part long, path string, docs long, tokens long"
    return spark.createDataFrame(dealt.mapInArrow(write, schema).collect(), schema)  # a row for each shard


def _read(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            store, root = open_folder(path)
            with store.open_input_file(root) as file:
                out: list[tuple] = []
                for doc_id, own in sstable.Reader(file).scan():
                    raw = own.astype("<u4").tobytes()
                    out.append((doc_id, start, len(own), zlib.crc32(raw), *([own.astype(np.int32).tolist()] * ids)))
                    start += len(own)
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if k == 4 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if k == 4 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=names)


def read_shards(spark: SparkSession, shards: DataFrame, ids: bool = False) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before. The driver sees a row per
    shard, never one per document.
    """
    listed = sorted(shards.select("part", "path", "tokens").collect())
    starts = np.concatenate([[0], np.cumsum([x["tokens"] for x in listed])]).tolist()
    places = [(x["path"], s) for x, s in zip(listed, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    given = spark.createDataFrame(places, "path string, start long")
    return given.repartition(max(1, len(places))).mapInArrow(functools.partial(_read, ids=ids), schema)


def _find(batches: Iterator[pa.RecordBatch], wanted: list[int | None]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            store, root = open_folder(path)
            with store.open_input_file(root) as file:
                reader = sstable.Reader(file)
                got = [(x, ids.astype(np.int32).tolist()) for x in wanted if (ids := reader.get(x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def lookup(shards: DataFrame, wanted: list[int | None]) -> DataFrame:
    """(doc_id, ids) of the ids in a short list, by filter and binary search in each shard."""
    return shards.select("path").mapInArrow(functools.partial(_find, wanted=wanted), "doc_id long, ids array<int>")
