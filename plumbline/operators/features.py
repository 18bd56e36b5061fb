"""Point-in-time features: what could be known about a game at an explicit moment, and nothing later.

A schedule is visible once a game has started, its result a fixed delay later.
Live slates and backtests go through the same function, with other targets.
No price is among the features.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import haversine_km, result_delay
from plumbline.schemas import DENSITY_SECONDS

TEAM = ("sport", "season", "team")
GAME = ("sport", "season", "game_id")


class LeakError(ValueError):
    """Something would be known before its time."""


def check_as_of(as_of: object) -> int:
    """Whole seconds since 1970; nothing that could mean something else."""
    if isinstance(as_of, bool) or not isinstance(as_of, int):
        raise TypeError("as_of is a whole number of seconds since 1970")
    return as_of


def neutral(games: DataFrame, sites: DataFrame | None) -> DataFrame:
    """``neutral`` holds if the row says so or the list of neutral sites has the game."""
    flag = F.coalesce("neutral_site", F.lit(False))
    if sites is None:
        return games.withColumn("neutral", flag)
    listed = sites.select(*GAME).distinct().withColumn("__listed", F.lit(True))
    return games.join(listed, list(GAME), "left").withColumn("neutral", flag | F.col("__listed").isNotNull()).drop("__listed")


def by_team(df: DataFrame, *keep: str) -> DataFrame:
    """Two rows per game, one for each side; ``host`` is where it is played."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("team"))
    return df.select(*GAME, F.col("home").alias("host"), "neutral", "et_date", *keep, F.inline(F.array(side("away"), side("home"))))


def backtest_targets(games: DataFrame, lead_seconds: int) -> DataFrame:
    """Each game as a target at its own start less a lead."""
    if check_as_of(lead_seconds) < 0:
        raise ValueError("a lead is not below 0")
    return games.select(*GAME, "et_date", "away", "home", "neutral_site", (F.col("start_t") - lead_seconds).alias("as_of"))


def targets_at(slate: DataFrame, as_of: int) -> DataFrame:
    return slate.select(*GAME, "et_date", "away", "home", "neutral_site").withColumn("as_of", F.lit(check_as_of(as_of)).cast("long"))


def refuse_started(targets: DataFrame, games: DataFrame) -> None:
    started = targets.join(games.select(*GAME, "start_t"), list(GAME)).where("start_t < as_of")
    if not started.isEmpty():
        raise LeakError("a target has started before its as-of time")


def _history(asked: DataFrame, played: DataFrame, delays: Mapping[str, int] | None) -> DataFrame:
    """Each asked side with its team's previous game and what was known of earlier ones, at its own as-of time.

    Starts, results becoming public, and questions are rows of one timeline per
    team and season; counts run along it. So a question meets no pairs, and all
    of it is one shuffle and one sort. At one time a result comes before a
    question (it is public by then) and a start after it (it is not earlier). A
    second question a week before gives the games of the last seven days.
    """
    none = lambda c: F.lit(None).cast(c)
    row, prev = F.struct(*asked.columns), F.struct(F.col("start_t").alias("at"), F.col("et_date").alias("prev_date"), F.col("host").alias("prev_host"), F.col("neutral").alias("prev_neutral"), F.col("game_id").alias("prev_game"))
    row_type, prev_type = asked.select(row.alias("x")).schema["x"].dataType, played.select(prev.alias("x")).schema["x"].dataType
    zero, one = F.lit(0), F.lit(1)

    def events(df: DataFrame, at: Column, order: int, games: Column = zero, settled: Column = zero, wins: Column = zero, kept: Column | None = None, question: Column | None = None, now: bool = True) -> DataFrame:
        return df.select(*TEAM, at.cast("long").alias("at"), F.lit(order).alias("order"), games.alias("games"), settled.alias("settled"), wins.alias("wins"), (none(prev_type) if kept is None else kept).alias("kept"), (none(row_type) if question is None else question).alias("row"), F.lit(now).alias("now"), "game_id")

    won = F.coalesce((F.col("winner") == F.col("side")).cast("int"), zero)
    timeline = (
        events(played, F.col("start_t") + result_delay("sport", delays), 0, settled=one, wins=won)
        .unionByName(events(asked, F.col("as_of"), 1, question=row))
        .unionByName(events(asked, F.col("as_of") - DENSITY_SECONDS, 1, question=row, now=False))
        .unionByName(events(played, F.col("start_t"), 2, games=one, kept=prev))
    )
    along = Window.partitionBy(*TEAM).orderBy("at", "order", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = timeline.withColumns({"prior_games": F.sum("games").over(along), "prior_settled": F.sum("settled").over(along), "prior_wins": F.sum("wins").over(along), "prev": F.last("kept", ignorenulls=True).over(along)}).where("row is not null")
    own = F.when(F.col("now"), F.struct("row", "prev", "prior_games", "prior_settled", "prior_wins"))
    both = counted.groupBy(*TEAM, "game_id", F.col("row.side").alias("__side"), F.col("row.as_of").alias("__as_of")).agg(F.first(own, ignorenulls=True).alias("own"), F.max(F.when(~F.col("now"), F.col("prior_games"))).alias("before_week"))
    return both.select("own.row.*", "own.prev.prev_date", "own.prev.prev_host", "own.prev.prev_neutral", "own.prior_games", "own.prior_settled", "own.prior_wins", (F.col("own.prior_games") - F.col("before_week")).alias("games_7d"))


def assemble(games: DataFrame, targets: DataFrame, venues: DataFrame, sites: DataFrame | None = None, delays: Mapping[str, int] | None = None, *, check: bool = True) -> DataFrame:
    """One row per target: rest, travel and form of both sides, and their differences (home - away).

    Rest and back-to-back are null without an earlier game; travel and time
    shift also where either game was at a neutral site; win rates where no
    result is public. Teams that ``venues`` lacks have no travel.
    """
    if check:
        refuse_started(targets, games)
    played = by_team(neutral(games, sites), "start_t", "winner")
    asked = by_team(neutral(targets, sites), "as_of")

    history = _history(asked, played, delays)

    place = lambda prefix: venues.select("sport", F.col("team").alias(prefix), F.col("lat").alias(f"{prefix}_lat"), F.col("lon").alias(f"{prefix}_lon"), F.col("tz_offset_std").alias(f"{prefix}_tz"))
    located = history.join(place("host"), ["sport", "host"], "left").join(place("prev_host"), ["sport", "prev_host"], "left")
    has = F.col("prev_date").isNotNull()
    known = has & ~F.col("neutral") & ~F.coalesce("prev_neutral", F.lit(True))
    rest = F.date_diff("et_date", "prev_date")
    values = {
        "rest_days": F.when(has, rest),
        "b2b": F.when(has, rest == 1),
        "first_of_season": ~has,
        "travel_km": F.when(known, haversine_km("prev_host_lat", "prev_host_lon", "host_lat", "host_lon")),
        "tz_shift": F.when(known, F.col("host_tz") - F.col("prev_host_tz")),
        "travel_known": known,
        "games_7d": F.col("games_7d"),
        "prior_games": F.col("prior_games"),
        "prior_settled": F.col("prior_settled"),
        "win_rate": F.when(F.col("prior_settled") > 0, F.col("prior_wins") / F.col("prior_settled")),
    }
    sides = located.select(*GAME, "side", "et_date", "as_of", "neutral", "team", *(v.alias(k) for k, v in values.items()))
    own = F.struct("team", *values)
    of = lambda s: F.first(F.when(F.col("side") == s, own), ignorenulls=True).alias(s)
    pairs = sides.groupBy(*GAME, "et_date", "as_of", "neutral").agg(of("away"), of("home"))
    both = pairs.select(*GAME, "et_date", "as_of", "neutral", *(F.col(f"{s}.team").alias(f"__{s}") for s in ("away", "home")), *(F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in ("away", "home") for k in values)).withColumnsRenamed({"__away": "away", "__home": "home"})
    differences = [(F.col(f"home_{k}") - F.col(f"away_{k}")).alias(f"{k}_diff") for k in ("rest_days", "travel_km", "games_7d", "win_rate")]
    return both.select("*", *differences)


def truncated(games: DataFrame, as_of: int) -> DataFrame:
    """The games as they were known at a moment: later ones are gone, results that weren't public are empty."""
    public = F.col("start_t") + result_delay("sport") <= as_of
    return games.where(F.col("start_t") < as_of).withColumn("winner", F.when(public, F.col("winner")))


def canary(games: DataFrame, targets: DataFrame, venues: DataFrame, as_of: int, sites: DataFrame | None = None) -> DataFrame:
    """Rows in which features from all games and from those known at ``as_of`` differ: none, unless something leaks."""
    at = targets_at(targets, as_of)
    full, cut = (assemble(g, at, venues, sites, check=False) for g in (games, truncated(games, as_of)))
    return full.exceptAll(cut).withColumn("only_in", F.lit("full")).unionByName(cut.exceptAll(full).withColumn("only_in", F.lit("truncated")))
