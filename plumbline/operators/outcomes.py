"""Every scheduled game is either priced or missed, once: the store's books and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("sport", "season", "game_id")
#: Parts into which games are dealt to be told apart, for each of a usual shuffle; too many to be put together again.
DEALT = 4


class BooksError(AssertionError):
    """The books don't balance."""


def scoped(df: DataFrame, sport: str | None = None, season: str | None = None) -> DataFrame:
    if sport is not None:
        df = df.where(F.col("sport") == sport)
    return df if season is None else df.where(F.col("season") == season)


def one_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; an empty list is refused, as it would quietly select nothing."""
    if not values:
        raise ValueError(f"no values for {column}")
    return df.where(F.col(column).isin(list(values)))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in ``order``: an idempotent upsert of a log."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))))
    return ranked.where("__n = 1").drop("__n")


def settled(priced: DataFrame, misses: DataFrame) -> DataFrame:
    """The games of either, each once; dealt out by key before they are held to each other, so that no task holds many."""
    both = priced.select(*KEY).union(misses.select(*KEY))
    return both.repartition(DEALT * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY).distinct()


def reconcile(games: DataFrame, priced: DataFrame, misses: DataFrame, by: Sequence[str] = ("sport", "season")) -> DataFrame:
    """Counts by group in one pass: scheduled, priced, missed, gap (scheduled - priced - missed)."""
    tagged = [df.select(*by, F.lit(tag).alias("kind")) for df, tag in ((games, "scheduled"), (priced, "priced"), (misses, "missed"))]
    counts = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(*by).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("scheduled", "priced", "missed")))
    return counts.withColumn("gap", F.col("scheduled") - F.col("priced") - F.col("missed"))


def double_counted(priced: DataFrame, misses: DataFrame) -> DataFrame:
    return priced.select(*KEY).join(misses.select(*KEY), list(KEY), "left_semi")


def orphans(outcomes: DataFrame, games: DataFrame) -> DataFrame:
    return outcomes.join(games.select(*KEY), list(KEY), "left_anti")


def lost(attempted: DataFrame, done: DataFrame) -> DataFrame:
    """Attempted games that have no outcome."""
    return attempted.select(*KEY).distinct().join(done.select(*KEY), list(KEY), "left_anti")


def points_summary(quotes: DataFrame, priced: DataFrame, side: str = "home") -> DataFrame:
    """One row: points, series, priced games without their series, series without a priced game."""
    series = quotes.select(*KEY, "side").distinct()
    missing = priced.select(*KEY).join(series.where(F.col("side") == side), list(KEY), "left_anti")
    alone = series.select(*KEY).distinct().join(priced.select(*KEY), list(KEY), "left_anti")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(quotes, "points").crossJoin(one(series, "series")).crossJoin(one(missing, "missing_series")).crossJoin(one(alone, "orphan_series"))


def assert_reconciled(games: DataFrame, priced: DataFrame, misses: DataFrame, complete: bool = True) -> None:
    """Raises BooksError for a double count, an orphan, more outcomes than games, or (if complete) a game without outcome."""
    twice, strange = double_counted(priced, misses).count(), orphans(priced.select(*KEY).union(misses.select(*KEY)), games).count()
    if twice or strange:
        raise BooksError(f"{twice} games are priced and missed, {strange} outcomes have no game")
    bad = reconcile(games, priced, misses).where("gap <> 0" if complete else "gap < 0").limit(5).collect()
    if bad:
        raise BooksError(f"scheduled isn't priced + missed: {[r.asDict() for r in bad]}")


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def attempted_by_month(games: DataFrame, done: DataFrame) -> DataFrame:
    """Scheduled and settled games by sport and month."""
    marked = games.join(done.select(*KEY).distinct().withColumn("__done", F.lit(True)), list(KEY), "left")
    return marked.groupBy("sport", F.date_format("et_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("scheduled"), F.count("__done").alias("attempted"))


def series_fingerprint(quotes: DataFrame, keys: Sequence[str] = (*KEY, "side")) -> DataFrame:
    """Order doesn't matter: points, sum of times and rounded sum of rounded prices of each series."""
    return quotes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"), F.round(F.sum(F.round("p", 6)), 4).alias("sum_p"))


def content_digest(df: DataFrame, places: int = 9) -> DataFrame:
    """One row: rows and a digest of the content, the same for any order of rows; floats count rounded.

    Each row is hashed; the hashes are added up, so that nothing is sorted or
    gathered. Repeated rows count as often as they occur.
    """
    fields = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in sorted(df.dtypes)]
    hashed = df.select(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(20,0)")) for i in (1, 9, 17, 25)]
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(p.cast("string") for p in parts)), 256).alias("digest"))


def slice_games(games: DataFrame, limit: int, strategy: str = "head") -> DataFrame:
    """Of each sport and season ``limit`` games in order of date and id: the first ones, or evenly spread ones."""
    group = Window.partitionBy("sport", "season")
    ranked = games.withColumn("__n", F.row_number().over(group.orderBy("et_date", "game_id")) - 1).withColumn("__all", F.count(F.lit(1)).over(group))
    if strategy == "head":
        chosen = F.col("__n") < limit
    elif strategy == "stride":
        # row n is floor(i * all / limit) for an i below limit
        i = F.ceil(F.col("__n") * limit / F.col("__all"))
        chosen = (i < limit) & (F.floor(i * F.col("__all") / limit) == F.col("__n")) | (F.col("__all") <= limit)
    else:
        raise ValueError(strategy)
    return ranked.where(chosen).drop("__n", "__all")


def rematches(games: DataFrame) -> DataFrame:
    """Games whose pair of teams meets again in the same roles on the next day, so that a slug of that day is no proof."""
    next_day = games.select("sport", "away", "home", F.date_sub("et_date", 1).alias("et_date")).distinct()
    return games.join(next_day, ["sport", "away", "home", "et_date"], "left_semi").select(*games.columns)


def unique_places(labels: DataFrame, place: str = "place", by: Sequence[str] = ("sport",)) -> DataFrame:
    """Teams with the place as a label only where no other team of the group has it."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*by, place))
    return labels.withColumn("unique_place", F.when(many == 1, F.col(place)))


def difference(got: DataFrame, want: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that are missing, extra or changed between two tables."""
    g, w = (df.select(*key, F.struct(*values).alias(n)).distinct() for df, n in ((got, "__got"), (want, "__want")))
    kind = F.when(F.col("__got").isNull(), "missing").when(F.col("__want").isNull(), "extra").when(~F.col("__got").eqNullSafe(F.col("__want")), "changed")
    return g.join(w, list(key), "full").select(*key, kind.alias("kind")).where("kind is not null")


def random_games(games: DataFrame, n: int, by: Sequence[str] = ("sport", "season"), seed: int = 23) -> DataFrame:
    """``n`` games of each group, all of a smaller one: those with the least hashes of seed and key, so the same whatever the order or partitioning.

    A task hands on ``n`` rows of a group at most, as ranks are limited before
    the shuffle. Rows that repeat a key count one by one.
    """
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in KEY)), 256)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__draw"))
    return games.withColumn("__draw", draw).withColumn("__n", place).where(F.col("__n") <= n).drop("__draw", "__n")
