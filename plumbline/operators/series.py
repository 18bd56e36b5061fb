"""What single tick series tell: changes, flat runs, and whether two sides complement each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.asof import asof_join
from plumbline.schemas import PAIR_GAP, PAIR_MINIMUM, PAIR_SHARE, PAIR_TOLERANCE, PAIR_WINDOW, STALE_RUN


def price_changes(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points, changes of price and first time of each series."""
    before = F.lag("p").over(Window.partitionBy(*keys).orderBy("t", "p"))
    marked = quotes.withColumn("__before", before)
    changed = F.col("__before").isNotNull() & (F.col("p") != F.col("__before"))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count(F.when(changed, 1)).alias("changes"), F.min("t").alias("first_t"))


def stale_flat_run(quotes: DataFrame, keys: Sequence[str], run: int = STALE_RUN) -> DataFrame:
    """Is a series at least ``run`` points long and are the last ``run`` prices one?"""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("p")))
    tail = quotes.withColumn("__n", place).where(F.col("__n") <= run)
    return tail.groupBy(*keys).agg(((F.count(F.lit(1)) == run) & (F.min("p") == F.max("p"))).alias("stale_flat_run"))


def complementarity(home: DataFrame, away: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do home and away prices add up to 1 in the last hours before the start?

    ``home`` has keys, t, p and tip_t, ``away`` keys, t, p. Each home quote in
    the window meets the latest away quote up to a minute older. ``ok`` is null
    where too few meet.
    """
    seen = home.where((F.col("t") <= F.col("tip_t")) & (F.col("t") >= F.col("tip_t") - PAIR_WINDOW))
    pairs = asof_join(seen, away.select(*keys, "t", F.col("p").alias("p_away")).withColumnRenamed("t", "t_away"), keys, "t", "t_away", strict=False, take=["t_away", "p_away"], tolerance=PAIR_GAP, tie=["p_away"]).where("p_away is not null")
    fits = F.count(F.when(F.abs(F.col("p") + F.col("p_away") - 1) < PAIR_TOLERANCE, 1))
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), fits.alias("fitting"))
    return out.withColumn("complement_ok", F.when(F.col("pairs") >= PAIR_MINIMUM, F.col("fitting") >= PAIR_SHARE * F.col("pairs")))


def insert_series(series: DataFrame) -> DataFrame:
    """Series as two parallel arrays t and p, laid out as points; the shorter array is filled with null."""
    rest = [c for c in series.columns if c not in ("t", "p")]
    return series.select(*rest, F.inline(F.arrays_zip("t", "p")))


def live_complement(quotes: DataFrame, tolerance: float) -> DataFrame:
    """By game and poll: the sum of both midpoints, and whether it is 1 within the tolerance; null for one side alone."""
    out = quotes.groupBy("sport", "season", "game_id", "poll_seq").agg(F.sum("midpoint").alias("total"), F.count("midpoint").alias("sides"))
    return out.withColumn("ok", F.when(F.col("sides") == 2, F.abs(F.col("total") - 1) <= tolerance))
