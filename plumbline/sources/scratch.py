"""Tables and files of a job in the folder that its driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``, where nothing is yet.

    Where that isn't set a local session gets a temporary folder, and a cluster
    an error, as nothing else says what its executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        root = _local[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written to a shared folder of their own, for what reads them more than once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str):
    """(filesystem, path in it) by which a task reaches a shared folder, whatever store holds it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def dropped(path: str) -> None:
    """A shared folder goes, if it is there."""
    store, root = opened(path)
    if store.get_file_info(root).type.name == "Directory":
        store.delete_dir(root)
