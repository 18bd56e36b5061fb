"""An idempotent store of outcomes as an append-only log: the last entry of a game decides where it stands.

A priced row takes a game's miss away, and a miss its price and series, without
a transaction: both are entries of one log, and a table is a view of the last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.outcomes import KEY, latest
from plumbline.sources.files import Store

SCHEMA_VERSION = 2
#: By version: the columns that a table gets.
MIGRATIONS: dict[int, dict[str, Mapping[str, str]]] = {2: {"outcomes": {"detail": "string"}}}
_TABLES = {
    "games": "sport string, season string, game_id string, et_date date, away string, home string, winner string, neutral_site boolean, start_t long, entry long",
    "outcomes": "sport string, season string, game_id string, kind string, reason string, p_close double, volume double, label_agreement string, complement_ok boolean, detail string, entry long",
    "series": "sport string, season string, game_id string, side string, t array<long>, p array<double>, entry long",
    "runs": "run_id string, started_at timestamp, finished_at timestamp, manifest string, entry long",
}


class OutcomeStore:
    def __init__(self, spark: SparkSession, root: str, reasons: Sequence[str]):
        self.spark, self.files, self.reasons = spark, Store(spark, root), set(reasons)
        self._migrate()

    def _migrate(self) -> None:
        """Forward only; a store without a version is of version 1. New columns are read as null from older files."""
        have = int(self.files.read_text("version")) if self.files.exists("version") else 1
        if have > SCHEMA_VERSION:
            raise ValueError(f"the store has version {have}, newer than {SCHEMA_VERSION}")
        self.added = {t: c for v in range(have + 1, SCHEMA_VERSION + 1) for t, c in MIGRATIONS.get(v, {}).items()}
        self.files.write_text("version", str(SCHEMA_VERSION))

    @property
    def version(self) -> int:
        return int(self.files.read_text("version"))

    def log(self, name: str) -> DataFrame:
        path = self.files.path(name)
        return self.spark.read.schema(_TABLES[name]).parquet(path) if self.files.exists(name) else self.spark.createDataFrame([], _TABLES[name])

    def _next(self) -> int:
        """Entries are numbered by write, across all logs."""
        at = int(self.files.read_text("entry")) + 1 if self.files.exists("entry") else 1
        self.files.write_text("entry", str(at))
        return at

    def _append(self, name: str, df: DataFrame, entry: int) -> None:
        schema = T.StructType.fromDDL(_TABLES[name])
        whole = df.withColumn("entry", F.lit(entry).cast("long"))
        whole.select(*((F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(self.files.path(name))

    def put_games(self, games: DataFrame) -> None:
        self._append("games", games, self._next())

    def put_priced(self, rows: DataFrame, series: DataFrame) -> None:
        """Priced games with their series (arrays t and p); each takes the place of what stood for the game."""
        entry = self._next()
        self._append("series", series, entry)
        self._append("outcomes", rows.withColumn("kind", F.lit("priced")), entry)

    def put_misses(self, rows: DataFrame) -> None:
        unknown = rows.where(~F.coalesce(F.col("reason").isin(self.reasons), F.lit(False))).select("reason").distinct().limit(5).collect()
        if unknown:
            raise ValueError(f"no such reasons: {[r[0] for r in unknown]}")
        self._append("outcomes", rows.withColumn("kind", F.lit("miss")), self._next())

    def start_run(self, run_id: str, manifest: str) -> None:
        self._append("runs", self.spark.createDataFrame([(run_id, manifest)], "run_id string, manifest string").withColumn("started_at", F.current_timestamp()), self._next())

    def finish_run(self, run_id: str) -> None:
        own = self.runs().where(F.col("run_id") == run_id).drop("entry").withColumn("finished_at", F.current_timestamp())
        self._append("runs", own, self._next())

    def runs(self) -> DataFrame:
        return latest(self.log("runs"), ["run_id"], ["entry"])

    def games(self) -> DataFrame:
        return latest(self.log("games"), KEY, ["entry"]).drop("entry")

    def _last(self) -> DataFrame:
        return latest(self.log("outcomes"), KEY, ["entry"])

    def priced(self) -> DataFrame:
        return self._last().where("kind = 'priced'").drop("kind", "reason", "entry")

    def misses(self) -> DataFrame:
        return self._last().where("kind = 'miss'").select(*KEY, "reason", "detail")

    def quotes(self) -> DataFrame:
        """Points of the games that are priced now, from the write that priced them."""
        now = self._last().where("kind = 'priced'").select(*KEY, "entry")
        return self.log("series").join(now, [*KEY, "entry"], "left_semi").select(*KEY, "side", F.inline(F.arrays_zip("t", "p")))

    def pending(self) -> DataFrame:
        """Games without an outcome: what a run that is resumed has left to do."""
        return self.games().join(self._last().select(*KEY), list(KEY), "left_anti")
