"""A seal on the labels of the season that is held out: no fit sees them, and no score before it is opened."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.files import Store

MARKER = "opened.json"


class SealError(RuntimeError):
    """Held-out labels would be used."""


def assert_dev_only(rows: DataFrame, sealed: str, what: str = "fit") -> None:
    """Refuses rows of the sealed season, and rows that don't say theirs."""
    bad, unknown = rows.agg(F.count(F.when(F.col("season") == sealed, 1)), F.count(F.when(F.col("season").isNull(), 1))).first()
    if bad or unknown:
        raise SealError(f"{what}: {bad} rows of {sealed}, {unknown} without season")


class Seal:
    """``clean`` and ``published`` tell whether the work is committed and pushed; both must hold to open it."""

    def __init__(self, spark: SparkSession, root: str, season: str, clean: Callable[[], bool], published: Callable[[], bool]):
        self.files, self.season, self.clean, self.published = Store(spark, root), season, clean, published

    def is_open(self) -> bool:
        return self.files.exists(MARKER)

    def open(self, games: DataFrame, who: str) -> DataFrame:
        """Opens it for good, once: the marker is written before a label is given out."""
        if self.is_open():
            raise SealError("already open")
        if not self.clean() or not self.published():
            raise SealError("work isn't committed and published")
        labels = games.where(F.col("season") == self.season).select("sport", "season", "game_id", (F.col("winner") == "home").cast("int").alias("y"))
        own = labels.select(F.sha2(F.concat_ws("|", "sport", "season", "game_id", F.col("y").cast("string")), 256).alias("h")).agg(F.count("h").alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).alias("s")).first()
        digest = hashlib.sha256(f"{own['n']}|{own['s']}".encode()).hexdigest()
        self.files.write_text(MARKER, json.dumps({"season": self.season, "who": who, "labels": digest, "n": own["n"]}))
        return labels

    def assert_scorable(self, rows: DataFrame, what: str = "score") -> None:
        if not self.is_open():
            assert_dev_only(rows, self.season, what)
