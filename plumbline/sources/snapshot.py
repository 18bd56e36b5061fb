"""Immutable, checksummed snapshots: Parquet by sport and season, and a manifest of every file's SHA-256."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.files import Store

MANIFEST = "manifest.json"
PARTITIONS = ("sport", "season")
#: Bytes that a row and the rest may take, when room is looked for.
ROW_BYTES, SPARE_BYTES = 4, 200 * 2**20


class SnapshotError(RuntimeError):
    """A snapshot can't be made, or isn't what it was."""


def released(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text in UTC, which no reader can shift."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'") for c, t in df.dtypes if t.startswith("timestamp")})


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """name and sha256 of each data file; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select(F.regexp_extract("path", r"/((?:[^/]+/)+[^/]+\.parquet)$", 1).alias("whole"), F.sha2("content", 256).alias("sha256")).select(F.element_at(F.split("whole", f"/{root.rstrip('/').rpartition('/')[2]}/"), -1).alias("name"), "sha256")


def create_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, preflight: Callable[[], None] = lambda: None, free_bytes: int | None = None, today: str | None = None) -> str:
    """Writes the tables under a temporary name, then renames them to ``census-<date>-<digest>``; returns that name.

    Tables without rows have no folder. ``preflight`` raises if the books don't
    balance; nothing is written then. Ticks are not sorted. The same content
    gives the same digest and is not written twice, whatever the date (UTC).
    """
    preflight()
    store = Store(spark, root)
    rows = {name: df.count() for name, df in tables.items()}
    need = sum(rows.values()) * ROW_BYTES + SPARE_BYTES
    if need > (store.free_bytes() if free_bytes is None else free_bytes):
        raise SnapshotError(f"needs {need} bytes")
    held = f"tmp-{uuid.uuid4().hex[:12]}"
    try:
        for name, df in tables.items():
            if rows[name]:
                by = [c for c in PARTITIONS if c in df.columns]
                writer = released(df).write.option("compression", "zstd")
                (writer.partitionBy(*by) if by else writer).parquet(store.path(f"{held}/{name}"))
        files = {r["name"]: r["sha256"] for r in checksums(spark, store.path(held)).collect()} if any(rows.values()) else {}
        digest = content_name(rows, tables)
        same = [n for n in store.names() if n.startswith("census-") and n.endswith(f"-{digest}")]
        if same:
            store.delete(held)
            return max(same)
        name = f"census-{today or time.strftime('%Y%m%d', time.gmtime())}-{digest}"
        store.write_text(f"{held}/{MANIFEST}", json.dumps({"rows": rows, "files": files, "schemas": {n: released(df).schema.json() for n, df in tables.items()}}, sort_keys=True, indent=1))
        store.rename(held, name)
        return name
    except BaseException:
        store.delete(held)
        raise


def content_name(rows: Mapping[str, int], tables: Mapping[str, DataFrame]) -> str:
    import hashlib

    from plumbline.operators.outcomes import content_digest

    parts = [f"{n}:{rows[n]}:{content_digest(released(df)).first()['digest'] if rows[n] else ''}" for n, df in sorted(tables.items())]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:12]


def verify_snapshot(spark: SparkSession, path: str) -> dict:
    """The manifest, once every file is there, no other is, and all hash as they did."""
    store = Store(spark, path)
    if not store.exists(MANIFEST):
        raise SnapshotError("no manifest")
    manifest = json.loads(store.read_text(MANIFEST))
    found = {r["name"]: r["sha256"] for r in checksums(spark, path).collect()} if any(store.exists(n) for n in manifest["rows"]) else {}
    wanted = manifest["files"]
    wrong = {"missing": sorted(wanted.keys() - found.keys()), "extra": sorted(found.keys() - wanted.keys()), "changed": sorted(n for n in wanted.keys() & found.keys() if wanted[n] != found[n])}
    if any(wrong.values()):
        raise SnapshotError(str(wrong))
    return manifest


def open_snapshot(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables, with sport and season as text whatever they look like; also as views. Tables without rows are empty."""
    from pyspark.sql import types as T

    manifest = verify_snapshot(spark, path) if verify else json.loads(Store(spark, path).read_text(MANIFEST))
    out = {}
    for name, text in manifest["schemas"].items():
        schema = T.StructType.fromJson(json.loads(text))
        out[name] = spark.read.schema(schema).parquet(f"{path}/{name}") if manifest["rows"][name] else spark.createDataFrame([], schema)
        out[name].createOrReplaceTempView(name)
    return out


def latest_snapshot(spark: SparkSession, root: str) -> str:
    """The path of the snapshot of the latest date; of one day that of the largest digest."""
    found = sorted(n for n in Store(spark, root).names() if n.startswith("census-"))
    if not found:
        raise SnapshotError(f"no snapshot in {root}")
    return f"{root}/{found[-1]}"
