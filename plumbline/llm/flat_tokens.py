"""Token counts from flat files of ids that have no index.

A file holds the ids of its documents, each closed by an end-of-document id,
and nothing else. It is read in blocks, by independent tasks: each searches its
block for the end id at once and reports how many there are, the ids before the
first and behind the last, and the lengths between. A prefix scan over the
blocks of a file then gives each block the number of documents before it and
the ids that its first document has in earlier blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.encoder import encoder, forget, narrow
from plumbline.llm.shared import holding, mapped, new_folder, open_folder, text_batches

BATCH_ROWS = 256
#: Ids in a block of a file, 16 MB of 16-bit ids.
BLOCK_IDS = 8 * 1024 * 1024


@holding(forget)
def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, keeps_space: bool, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One flat file for the partition; yields for each document the file and its place there, then the file's size."""
    task = TaskContext.get()
    store, root = open_folder(folder)
    name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
    encode, end = encoder(tokenizer, keeps_space).encode, np.array([end_id], "<u2").tobytes()
    schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("id", id_type), ("size", pa.int64())])
    file, docs, size = None, 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(i, BATCH_ROWS)
            if file is None:
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{root}/{name}")
            for raw in encode(part["text"].to_pylist()):
                own = narrow(raw) + end
                file.write(own)
                size += len(own) // 2
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(docs, docs + n)), batch["id"], pa.nulls(n, pa.int64())], schema=schema)
        docs += n
    if file is not None:
        file.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.array([size])], schema=schema)


def write_flat(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes a flat file of 16-bit ids for each partition. Returns (path, place, id) by document and (path, size) by file.

    A null or empty text is just an end id. An id above 65,535 raises; text must
    not give ``end_id``. Null and repeated ids pass as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    write = functools.partial(_write, folder=new_folder(docs.sparkSession, "op3-flat"), tokenizer=tokenizer, keeps_space=keeps_space, end_id=end_id, id_type=to_arrow_type(kind))
    out = mapped(rows, write, f"path string, place long, id {kind.simpleString()}, size long", "op3-list")
    return out.where("size is null").drop("size"), out.where("size is not null").select("path", "size")


def _scan(batches: Iterator[pa.RecordBatch], end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, block in zip(batch["path"].to_pylist(), batch["block"].to_pylist(), strict=True):
            store, root = open_folder(path)
            with store.open_input_file(root) as file:
                file.seek(block * block_ids * 2)
                ids = np.frombuffer(file.read(block_ids * 2), "<u2")
            ends = np.flatnonzero(ids == end_id)
            head = int(ends[0]) + 1 if len(ends) else 0
            tail = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "ends": [len(ends)], "head": [head], "tail": [tail], "lengths": pa.array([np.diff(ends)], pa.list_(pa.int64()))})


def scan_flat(files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document of flat files: path, place (from 0 in its file), n_tokens (with the end id).

    ``files`` has path and size (ids). Files without ids have no row; ids behind
    a file's last end id are no document.
    """
    blocks = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block_ids}"))).alias("block"))
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    # a block stands for megabytes, so its few bytes are dealt out by number
    found = blocks.repartition(4 * n, "path", "block").mapInArrow(functools.partial(_scan, end_id=end_id, block_ids=block_ids), "path string, block long, ends long, head long, tail long, lengths array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    summed = found.withColumn("docs", zero(F.sum("ends").over(before))).withColumn("open", F.sum("tail").over(upto))
    # of the ids counted as open so far, those of blocks before the last end id are closed
    closed = summed.withColumn("closed", F.when(F.col("ends") > 0, F.col("open") - F.col("tail")))
    carried = closed.withColumn("carry", zero(F.lag("open").over(Window.partitionBy("path").orderBy("block"))) - zero(F.last("closed", True).over(before)))
    own = carried.where("ends > 0").select("path", "docs", F.concat(F.array(F.col("carry") + F.col("head")), "lengths").alias("lengths"))
    return own.select("path", "docs", F.posexplode("lengths").alias("at", "n_tokens")).select("path", (F.col("docs") + F.col("at")).alias("place"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id and n_tokens (with the end id) of every document, counted in flat files that are written first.

    A null or empty text counts 1, its end id. Rows that repeat an id, or have
    none, each have a row of their own; an empty table gives an empty result.
    Other columns play no part. The vocabulary must be as ``write_flat`` says.
    """
    places, files = write_flat(docs, tokenizer, keeps_space, end_id, id_col, text_col)
    # both sides grow with the documents, so neither is broadcast
    return places.join(scan_flat(files, end_id, block_ids).hint("merge"), ["path", "place"]).select(F.col("id").alias("doc_id"), "n_tokens")
