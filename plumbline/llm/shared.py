"""The shared folder of a job: tables and files that every executor can read.

Lineage is cut by writing a table here and reading it again, so that a lost
executor costs a re-run of one stage and no intermediate result lives on the
local disk of one machine.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset.

    Without the setting a local session gets a temporary folder. A cluster must
    have it: nothing else says which folder its executors share.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own[app] = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own[app]


_local = threading.local()


def _scratch() -> list[str]:
    """The folders of the blocks that this thread is in."""
    if not hasattr(_local, "folders"):
        _local.folders = []
    return _local.folders


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators put into the shared folder within this block goes at its end; results must be written by then."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch().append(path)
    try:
        yield
    finally:
        _scratch().remove(path)
        store, root = open_folder(path)
        if store.get_file_info(root).type.name == "Directory":
            store.delete_dir(root)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is made there yet."""
    return f"{own[-1] if (own := _scratch()) else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    ``narrow``: its rows are a few numbers each, so it goes in an eighth as many
    files as the session has shuffle partitions.
    """
    path = new_folder(df.sparkSession, name)
    (df.coalesce(max(4, partitions(df.sparkSession) // 8)) if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a worker gathers for a row group.
GROUP_BYTES = 16_000_000


def _put_rows(batches: Iterator[pa.RecordBatch], f: Callable, folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    task = TaskContext.get()
    store, root = open_folder(folder)
    own, held, size, rows, writer = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}", [], 0, 0, None
    for batch in f(batches):
        held.append(batch.cast(schema) if batch.schema != schema else batch)
        size, rows = size + batch.nbytes, rows + batch.num_rows
        if size >= GROUP_BYTES:
            if writer is None:
                file = store.open_output_stream(own)
                writer = pq.ParquetWriter(file, schema)
            writer.write_table(pa.Table.from_batches(held, schema))
            held, size = [], 0
    if rows:
        if writer is None:
            file = store.open_output_stream(own)
            writer = pq.ParquetWriter(file, schema)
        writer.write_table(pa.Table.from_batches(held, schema))
        writer.close()
        file.close()
        _settle(store, own, f"{root}/part-{task.partitionId():06d}.parquet")
    yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})


def mapped(df: DataFrame, f: Callable, schema: str, name: str) -> DataFrame:
    """``f`` over the Arrow batches of ``df``, written to the shared folder by the workers themselves and read again.

    A task's file gets its name when it is whole; of several attempts one stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    kinds = StructType.fromDDL(schema)
    store, root = open_folder(path)
    store.create_dir(root, recursive=True)
    put = functools.partial(_put_rows, f=f, folder=path, schema=to_arrow_schema(kinds))
    df.mapInArrow(put, "rows long").agg(F.sum("rows")).first()
    return spark.read.schema(kinds).parquet(path)


#: Rows of whole texts that go to Python at a time; Spark's own default is meant for short rows.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold so few rows that texts of some 10 KB make batches of some 10 MB."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Seconds after its last task at which a worker gives up the tables that it holds.
IDLE_S = 1.0
_lock = threading.Lock()
_held: dict[Callable[[], None], None] = {}
_running, _timer = 0, None


def _release() -> None:
    with _lock:
        if _running:
            return
        for forget in _held:
            forget()
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def holding(forget: Callable[[], None]):
    """For functions over batches that keep tables in their worker, for the tasks that come after them.

    Workers outlive their tasks. ``forget`` is called once no such function has
    run in the worker for a second, and before one that holds other tables.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(batches, *args, **kwargs):
            global _running, _timer
            with _lock:
                _running += 1
                if _timer is not None:
                    _timer.cancel()
                for other in [x for x in _held if x is not forget and _running == 1]:
                    del _held[other]
                    other()
                _held[forget] = None
            try:
                yield from f(batches, *args, **kwargs)
            finally:
                with _lock:
                    _running -= 1
                    if not _running:
                        _timer = threading.Timer(IDLE_S, _release)
                        _timer.daemon = True
                        _timer.start()

        return run

    return wrap


def drop_rows(docs: DataFrame, key: Column, marks: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without some rows. ``marks`` has __id, __key, kept and all: pairs with rows to drop.

    Where no row of a pair (id, key) is kept all go, where some are one stays. A
    null id equals a null id. Columns of ``docs`` may have any names.
    """
    marks = written(marks, "marks", narrow=True)
    same = lambda m: F.col("id").eqNullSafe(m["__id"]) & (F.col("key") == m["__key"])
    gone, repeated = marks.where("not kept").select("__id", "__key"), marks.where("kept and not all").select("__id", "__key")
    left = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(id_col)).alias("id"), key.alias("key"))
    # what goes grows with the documents, so it is dealt out with them at every size and never broadcast
    left = left.join(gone.hint("merge"), same(gone), "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    left = written(left, "left")
    once = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "key"])
    return left.join(repeated, same(repeated), "left_anti").unionByName(once).select("row.*")


def quoted(column: str) -> str:
    """A column's name as it may stand in an expression, whatever it is made of."""
    return f"`{column.replace('`', '``')}`"


def put_file(folder: str, name: str, data: bytes) -> None:
    """In a task: a file of the shared folder that is there whole or not at all; of several attempts one file stays."""
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as file:
        file.write(data)
    _settle(store, own, f"{root}/{name}")


def _settle(store, own: str, path: str) -> None:
    try:
        store.move(own, path)
    except OSError:  # a store that doesn't replace: another attempt was first
        if not store.get_file_info(path).is_file:
            raise
        store.delete_file(own)


def files_of(folder: str) -> dict[str, bytes]:
    """What ``put_file`` has put into a folder, by name; nothing if there is no such folder."""
    from pyarrow import fs

    store, root = open_folder(folder)
    out = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.is_file and not info.base_name.startswith("."):
            with store.open_input_stream(info.path) as file:
                out[info.base_name] = file.read()
    return out


def open_folder(path: str):
    """(filesystem, path in it) by which Python reaches a shared folder, whatever store holds it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def normalised(column: str):
    """Text with each run of ASCII white space as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(quoted(column)), F.lit("")), WHITESPACE, " ")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
