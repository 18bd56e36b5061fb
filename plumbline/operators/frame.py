"""The analysis frame: one row per priced game, home side, in canonical order, and its strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import winner_label
from plumbline.operators.outcomes import KEY
from plumbline.operators.quantiles import quantiles, same

LOOKS = ("p_close", "p_t1h", "p_t6h", "p_t24h")


def with_week(games: DataFrame) -> DataFrame:
    """``week_of_season``: 1 for the first seven days of a sport's season."""
    firsts = games.groupBy(F.col("sport").alias("sport_"), F.col("season").alias("season_")).agg(F.min("et_date").alias("__first"))
    week = F.lit(1) + F.floor(F.date_diff("et_date", "__first") / 7).cast("int")
    return games.join(firsts, same(("sport", "season"))).withColumn("week_of_season", week).drop("sport_", "season_", "__first")


def analysis_frame(priced: DataFrame, games: DataFrame, patch: DataFrame | None = None) -> DataFrame:
    """Prices, label and week of each priced game. The label is the schedule's winner.

    A missing volume comes from the patch, if it has one, and stays null
    otherwise; ``volume_source`` tells which.
    """
    weeks = with_week(games).select(*KEY, "week_of_season", winner_label("winner").alias("y"), "et_date")
    out = priced.join(weeks, list(KEY))
    if patch is None:
        recovered, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    else:
        out = out.join(patch.select(*KEY, "volume_recovered", "volume_source"), list(KEY), "left")
        recovered, source = F.col("volume_recovered"), F.col("volume_source")
    told = F.when(F.col("volume").isNotNull(), "market").when(recovered.isNotNull(), source).otherwise("absent")
    return out.select(*KEY, "et_date", "week_of_season", F.coalesce("volume", recovered).alias("volume"), told.alias("volume_source"), *(c for c in priced.columns if c in LOOKS or c == "stale_flat_run"), "y")


def look(frame: DataFrame, name: str) -> DataFrame:
    """Rows that have the price, as p and y."""
    if name not in LOOKS:
        raise ValueError(f"{name} is no look")
    return frame.where(F.col(name).isNotNull() & F.col("y").isNotNull()).withColumn("p", F.col(name))


def look_coverage(frame: DataFrame, by: tuple[str, ...] = ("sport", "season")) -> DataFrame:
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), *(F.count(c).alias(f"n_{c}") for c in LOOKS if c in frame.columns))


def canonical(frame: DataFrame) -> DataFrame:
    return frame.orderBy(*KEY)


def coverage_by_week(games: DataFrame, priced: DataFrame, misses: DataFrame) -> DataFrame:
    """Scheduled, priced, missed, first date and median volume by week; raises where a week doesn't add up."""
    marked = (
        with_week(games)
        .join(priced.select(*KEY, "volume", F.lit(1).alias("__priced")), list(KEY), "left")
        .join(misses.select(*KEY, F.lit(1).alias("__missed")), list(KEY), "left")
    )
    weeks = marked.groupBy("sport", "season", "week_of_season").agg(F.count(F.lit(1)).alias("scheduled"), F.count("__priced").alias("priced"), F.count("__missed").alias("missed"), F.min("et_date").alias("first_date"), F.median("volume").alias("median_volume"))
    balanced = F.when(F.col("scheduled") == F.col("priced") + F.col("missed"), F.col("scheduled")).otherwise(F.raise_error(F.lit("a week doesn't add up")).cast("long"))
    return weeks.withColumn("scheduled", balanced)


def median_split(frame: DataFrame, value: str, within: tuple[str, ...], low: str, high: str, out: str) -> DataFrame:
    """``low`` up to the group's median, ``high`` above; null values have neither."""
    middle = quantiles(frame, value, [0.5], within).select(*(F.col(c).alias(f"{c}_") for c in within), F.col("q").alias("__middle"))
    side = F.when(F.col(value).isNull(), None).when(F.col(value) <= F.col("__middle"), low).otherwise(high)
    return frame.join(middle, same(within), "left").withColumn(out, side).drop("__middle", *(f"{c}_" for c in within))


def assign_strata(frame: DataFrame) -> DataFrame:
    """Phase by week within sport and season, liquidity by volume within phase."""
    phased = median_split(frame, "week_of_season", ("sport", "season"), "early", "late", "phase")
    return median_split(phased, "volume", ("sport", "season", "phase"), "low", "high", "liquidity")
