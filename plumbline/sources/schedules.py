"""Schedules from their sources: two rows per team to one game, nested weeks, scoreboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import aware_timestamp, parse_matchup


def fold_team_rows(rows: DataFrame) -> DataFrame:
    """Two rows of a game (game_id, et_date, matchup, team, pts) to one; a game without both sides gives none.

    The matchup tells who plays at home; the winner is who has more points.
    """
    told = rows.withColumn("m", parse_matchup("matchup")).withColumn("side", F.when(F.col("team") == F.col("m.home"), "home").when(F.col("team") == F.col("m.away"), "away"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    games = told.groupBy("game_id").agg(F.min("et_date").alias("et_date"), of("away", "team").alias("away"), of("home", "team").alias("home"), of("away", "pts").alias("away_pts"), of("home", "pts").alias("home_pts"))
    winner = F.when(F.col("home_pts") > F.col("away_pts"), "home").when(F.col("home_pts") < F.col("away_pts"), "away")
    return games.where("away is not null and home is not null").withColumn("winner", winner)


def attach_start_times(games: DataFrame, times: DataFrame) -> DataFrame:
    """The league's start of each game; text that stands for nothing is null."""
    known = times.select("game_id", F.when(~F.col("start_time_utc").isin("", "nan", "None"), F.col("start_time_utc")).alias("__start"))
    return games.join(known, "game_id", "left").withColumn("start_time_utc", aware_timestamp("__start")).drop("__start")


def finished_games(weeks: DataFrame, expected: int | None = None) -> DataFrame:
    """Regular-season games that are over, each once, from nested weeks; equal scores are refused, and another count than expected."""
    shape = "struct<gameWeek:array<struct<date:string,games:array<struct<id:long,gameType:int,gameState:string,startTimeUTC:string,awayTeam:struct<abbrev:string,score:int>,homeTeam:struct<abbrev:string,score:int>>>>>>"
    days = weeks.select(F.explode(F.from_json("body", shape)["gameWeek"]).alias("d"))
    rows = days.select(F.to_date("d.date").alias("et_date"), F.explode("d.games").alias("g")).where("g.gameType = 2 and g.gameState in ('OFF', 'FINAL')").dropDuplicates(["g"])
    home, away = F.col("g.homeTeam.score"), F.col("g.awayTeam.score")
    winner = F.when(home > away, "home").when(home < away, "away").otherwise(F.raise_error(F.lit("a finished game has equal scores")))
    games = rows.select(F.col("g.id").cast("string").alias("game_id"), "et_date", F.lower("g.awayTeam.abbrev").alias("away"), F.lower("g.homeTeam.abbrev").alias("home"), away.alias("away_pts"), home.alias("home_pts"), winner.alias("winner"), aware_timestamp("g.startTimeUTC").alias("start_time_utc")).dropDuplicates(["game_id"])
    if expected is not None and (n := games.count()) != expected:
        raise ValueError(f"{n} games, not {expected}")
    return games


def upcoming_games(scoreboards: DataFrame) -> DataFrame:
    """Games that have not begun, from scoreboards of single days; sides that aren't told are null."""
    team = "struct<homeAway:string,team:struct<abbreviation:string>>"
    shape = f"struct<events:array<struct<id:string,date:string,competitions:array<struct<neutralSite:boolean,status:struct<type:struct<state:string>>,competitors:array<{team}>>>>>>"
    events = scoreboards.select(F.explode(F.from_json("body", shape)["events"]).alias("e"))
    held = events.select("e.id", "e.date", F.get("e.competitions", F.lit(0)).alias("c"))
    side = lambda s: F.lower(F.get(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(0))["team"]["abbreviation"])
    return held.where("c.status.type.state = 'pre'").select(F.col("id").alias("game_id"), side("away").alias("away"), side("home").alias("home"), F.coalesce("c.neutralSite", F.lit(False)).alias("neutral_site"), aware_timestamp("date").alias("start_time_utc")).withColumn("et_date", F.to_date(F.from_utc_timestamp("start_time_utc", "America/New_York")))


def learned_abbreviations(markets: DataFrame) -> DataFrame:
    """By side and team label, the abbreviations that slugs use: ``abbr`` where there is one, all of them as ``conflict`` where there are more."""
    from plumbline.functions.scalars import normalised_label, parse_slug

    told = markets.withColumn("s", parse_slug("slug")).where("s is not null")
    pairs = told.select("s.sport", F.inline(F.array(F.struct(normalised_label("away_label").alias("label"), F.col("s.away").alias("abbr")), F.struct(normalised_label("home_label").alias("label"), F.col("s.home").alias("abbr")))))
    found = pairs.groupBy("sport", "label").agg(F.sort_array(F.collect_set("abbr")).alias("all"))
    one = F.size("all") == 1
    return found.select("sport", "label", F.when(one, F.element_at("all", 1)).alias("abbr"), F.when(~one, F.col("all")).alias("conflict"))
