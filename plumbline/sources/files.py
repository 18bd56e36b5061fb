"""Files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.path(old)} can't be renamed to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """As one step: written under another name, then renamed."""
        held = f"{name}.tmp"
        stream = self._fs.create(self._path(held), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self._fs.delete(self._path(name), False)
        self.rename(held, name)

    def free_bytes(self) -> int:
        return self._fs.getStatus(self._path("")).getRemaining() if self.exists() else self._fs.getStatus().getRemaining()


def read_or_empty(spark: SparkSession, path: str, schema) -> "object":
    """A Parquet table, or an empty one of the same columns where there is none: side tables may be missing."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if Store(spark, folder or "/").exists(name):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str):
    """A Parquet table that must be there: without it nothing that follows would mean anything."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if not Store(spark, folder or "/").exists(name):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
