"""Reports of a census: cutoffs, cross-checks of anchors, coverage, summaries of features, and orders of games."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import inv_logit, logit, settled_bet
from plumbline.operators import resample
from plumbline.operators.cox import CLIP, cox_by
from plumbline.operators.features import neutral
from plumbline.operators.outcomes import KEY
from plumbline.operators.scores import global_rank
from plumbline.schemas import COST_GRID, DECIDING_COST
from plumbline.sources.scratch import kept

SEASON = ("sport", "season")


def cutoff(source: str = "cutoff_source", league: str = "league_start_time", market: str = "game_start_time") -> Column:
    """Before what a price must be quoted: the league's start where that is the source, else the market's."""
    return F.when(F.col(source) == "league", F.col(league)).otherwise(F.col(market))


def horizon_pivot(anchors: DataFrame, horizons: Sequence[str], side: str) -> DataFrame:
    """A row for each game with an anchor of the side: its price at each horizon."""
    rows = anchors.where(F.col("side") == side)
    return rows.groupBy(*KEY).agg(*(F.max(F.when(F.col("horizon") == h, F.col("p"))).alias(f"p_{h}") for h in horizons))


def close_disagreements(priced: DataFrame, anchors: DataFrame, close: str = "p_home_close", side: str = "home") -> DataFrame:
    """Priced games whose close isn't that of the anchors, with both; a null equals a null only."""
    own = horizon_pivot(anchors, ["close"], side).withColumnRenamed("p_close", "p_anchor")
    return priced.select(*KEY, F.col(close).alias("p_census")).join(own, list(KEY), "left").where(~F.col("p_census").eqNullSafe(F.col("p_anchor")))


def coverage_report(games: DataFrame, priced: DataFrame, misses: DataFrame) -> DataFrame:
    """By season: games scheduled, priced, missed and attempted, and the share of the attempted that is priced (null without any)."""
    rows = games.select(*KEY).join(priced.select(*KEY, F.lit(1).alias("p")), list(KEY), "left").join(misses.select(*KEY, F.lit(1).alias("m")), list(KEY), "left")
    counts = rows.groupBy(*SEASON).agg(F.count(F.lit(1)).alias("scheduled"), F.count("p").alias("priced"), F.count("m").alias("missed"))
    tried = F.col("priced") + F.col("missed")
    return counts.withColumn("attempted", tried).withColumn("coverage", F.when(tried > 0, F.round(F.col("priced") / tried, 4)))


def value_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """By season, column and value how many rows; nulls count under the name that ``columns`` gives to them."""
    each = F.array(*(F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit(absent)).alias("value")) for c, absent in columns.items()))
    return df.select(*SEASON, F.inline(each)).groupBy(*SEASON, "what", "value").agg(F.count(F.lit(1)).alias("n"))


def feature_summary(features: DataFrame) -> DataFrame:
    """By season: games, percent with a side that played the day before, median travel, sides without a known place, first games."""
    share = lambda c: F.round(100 * F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 1)
    lost = lambda s: F.count(F.when(~F.col(f"{s}_travel_known") & ~F.col(f"{s}_first_of_season"), 1))
    first = lambda s: F.count(F.when(F.col(f"{s}_first_of_season"), 1))
    return features.groupBy(*SEASON).agg(F.count(F.lit(1)).alias("games"), share("away_b2b").alias("away_b2b"), share("home_b2b").alias("home_b2b"), F.round(F.median("away_travel_km")).alias("median_travel_km"), (lost("away") + lost("home")).alias("no_venue"), (first("away") + first("home")).alias("first_games"))


def sport_seasons(df: DataFrame) -> DataFrame:
    return df.select(*SEASON).distinct()


def worst_week(weeks: DataFrame) -> DataFrame:
    """Of each season the week with the least share of priced games, the earliest of several; weeks without games don't count."""
    share = F.col("priced") / F.col("scheduled")
    return weeks.where("scheduled > 0").groupBy(*SEASON).agg(F.min_by(F.struct("week_of_season", "priced", "scheduled"), F.struct(share, F.col("week_of_season"))).alias("w")).select(*SEASON, "w.*")


def probe_order(games: DataFrame) -> DataFrame:
    """``games`` with ``distance``, the days to the middle date, in order of that and id: the middle of a season first.

    The middle is the date in the middle of all games; one number per date meets in a task.
    """
    dates = games.groupBy("et_date").agg(F.count(F.lit(1)).alias("n"))
    upto = dates.select("et_date", F.sum("n").over(Window.orderBy("et_date")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    middle = upto.where("upto > total div 2").agg(F.min("et_date").alias("middle"))
    return games.crossJoin(middle).withColumn("distance", F.abs(F.date_diff("et_date", "middle"))).drop("middle").orderBy("distance", "game_id")


def with_burn_in(games: DataFrame, burn_in: DataFrame) -> DataFrame:
    """Games of a census and of the seasons before it, as a walk over ratings takes them; an unknown site isn't neutral."""
    columns = ("sport", "season", "game_id", "et_date", "away", "home", "away_pts", "home_pts", "winner", "start_t")
    site = F.coalesce("neutral_site", F.lit(False)).alias("neutral_site")
    return games.select(*columns, site).unionByName(burn_in.select(*columns, site))


def overridden(games: DataFrame, sites: DataFrame) -> DataFrame:
    """By sport, how many games the table of sites makes neutral that their own flag doesn't."""
    flag = F.coalesce("neutral_site", F.lit(False))
    return neutral(games.withColumn("own_flag", flag), sites).where(F.col("neutral") & ~F.col("own_flag")).groupBy("sport").agg(F.count(F.lit(1)).alias("n"))


def design(features: DataFrame, ratings: DataFrame, games: DataFrame) -> DataFrame:
    """Rows of a fit: features, the difference of ratings before the game, and the result; games that lack one of them have none."""
    rated = ratings.select(*KEY, (F.col("r_home") - F.col("r_away")).alias("rating_diff"))
    results = games.select(*KEY, (F.col("winner") == "home").cast("double").alias("y"), "start_t")
    return features.join(rated, list(KEY)).join(results, list(KEY))


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small result as one sorted Parquet file, in place of what was there."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").parquet(path)


def split_prize(rows: DataFrame, order: Sequence[str], date: str, costs: Sequence[tuple[float, float]] = COST_GRID, reps: int = 2000, seed: int = 0, stratum: str = "liquidity", p: str = "p", y: str = "y") -> DataFrame:
    """What a recalibration learned on the first half of each stratum earns on the second, betting one unit on either side, at each half spread and fee.

    A row for each cost: bets, roi (mean profit of a bet), its 90 % interval over
    resampled dates, dates with a bet, and whether it is the cell that decides.
    Without a bet all but the counts are null.
    """
    sound = rows.where((F.col(p) > 0) & (F.col(p) < 1) & F.col(y).isNotNull() & F.col(stratum).isNotNull())
    sound = kept(sound.select(*dict.fromkeys([*order, date, stratum, p, y])), "sound")  # for the bounds, the counts and the ranks
    ranked = kept(global_rank(sound, list(order), by=[stratum]).select(date, stratum, p, y, (F.col("rank") < F.floor(F.col("total") / 2)).alias("first")), "halves")  # for the fits and the bets
    fits = cox_by(ranked.where("first"), [stratum]).select(F.col(stratum).alias("__s"), "slope", "intercept")
    later = ranked.where("not first").join(fits, F.col(stratum) == F.col("__s"))  # a row for each stratum
    fair = inv_logit(F.col("intercept") + F.col("slope") * logit(p, CLIP))
    sides = F.array(F.struct(F.col(p).alias("paid"), fair.alias("fair"), (F.col(y) == 1).alias("won")), F.struct((1 - F.col(p)).alias("paid"), (1 - fair).alias("fair"), (F.col(y) == 0).alias("won")))
    grid = rows.sparkSession.createDataFrame([(float(h), float(f)) for h, f in costs], "half_spread double, fee double")
    cell = ["half_spread", "fee"]
    # the costs are a fixed few; a row for each cost and date is all that is read more than once
    bets = later.select(F.col(date).cast("string").alias("d"), F.inline(sides)).crossJoin(F.broadcast(grid)).withColumn("bet", settled_bet("paid", "fair", "won", *cell)).where("bet is not null").groupBy(*cell, "d").agg(F.sum("bet.profit").alias("profit"), F.count("bet.profit").alias("n")).persist()
    try:
        found = bets.groupBy(*cell).agg(F.sum("n").alias("bets"), (F.sum("profit") / F.sum("n")).alias("roi"), F.count("d").alias("dates")).collect()
        known = rows.sparkSession.createDataFrame([tuple(r) for r in found], "half_spread double, fee double, bets long, roi double, dates long")
        out = grid.join(known, cell, "left").select(*cell, F.coalesce("bets", F.lit(0)).alias("bets"), "roi", F.coalesce("dates", F.lit(0)).alias("dates"), ((F.col("half_spread") == DECIDING_COST[0]) & (F.col("fee") == DECIDING_COST[1])).alias("decides"))
        if not found:
            return out.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
        drawn = resample.dated_means(bets, "profit", "d", cell, reps, seed, times="n")
        return out.join(drawn.groupBy(*cell).agg(F.percentile("mean", 0.05).alias("lo"), F.percentile("mean", 0.95).alias("hi")), cell, "left")
    finally:
        bets.unpersist()
