"""The given tables seen as games, prices and quotes, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of all series of quotes, 2024-01-15 00:00 UTC, in seconds.
TIP = 1705276800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    home_wins = (F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "P") & (k % 2 == 0))
    return table(spark, sf_dir, "orders").select(
        F.when(c % 2 == 0, "nba").otherwise("nhl").alias("sport"),
        F.year("o_orderdate").cast("string").alias("season"),
        k.alias("game_id"),
        F.to_date("o_orderdate").alias("et_date"),
        F.concat(F.lit("t"), (c % 25).cast("string")).alias("away"),
        F.concat(F.lit("t"), ((c % 25 + 1 + k % 24) % 25).cast("string")).alias("home"),
        (F.when(home_wins, 90).otherwise(101) + k % 10).cast("int").alias("away_pts"),
        (F.when(home_wins, 101).otherwise(90) + k % 9).cast("int").alias("home_pts"),
        F.when(home_wins, "home").otherwise("away").alias("winner"),
        (k % 37 == 0).alias("neutral_site"),
        (F.unix_timestamp("o_orderdate") + 57600 + k % 20000).alias("start_t"),
    )


GAMES = """
games as (
  select case when o_custkey % 2 = 0 then 'nba' else 'nhl' end as sport, cast(year(o_orderdate) as varchar) as season,
    o_orderkey as game_id, cast(o_orderdate as date) as et_date,
    't' || cast(o_custkey % 25 as varchar) as away, 't' || cast((o_custkey % 25 + 1 + o_orderkey % 24) % 25 as varchar) as home,
    case when o_orderstatus = 'F' or (o_orderstatus = 'P' and o_orderkey % 2 = 0) then 'home' else 'away' end as winner,
    o_orderkey % 37 = 0 as neutral_site,
    cast(epoch(o_orderdate) as bigint) + 57600 + o_orderkey % 20000 as start_t
  from orders
)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), "o_orderstatus", "o_totalprice"), "game_id")


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with status F or O; prices lean to the winner so that they tell something."""
    k = F.col("game_id")
    base = (k * 7919 % 1000 + 0.5) / 1000.0
    lean = F.when(F.col("winner") == "home", 0.1).otherwise(-0.1)
    p = F.round(base * 0.8 + 0.1 + lean * 0.8, 6)
    return _outcomes(spark, sf_dir).where("o_orderstatus <> 'P'").select(
        "sport", "season", "game_id",
        p.alias("p_close"),
        F.when(k % 5 != 0, p * 0.9 + 0.05).alias("p_t1h"),
        F.when(k % 3 != 0, p * 0.8 + 0.1).alias("p_t6h"),
        F.when(k % 2 != 0, p * 0.5 + 0.25).alias("p_t24h"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("volume"),
        (k % 13 == 0).alias("stale_flat_run"),
        F.lit("agree").alias("label_agreement"),
        F.when(k % 40 != 0, True).alias("complement_ok"),
    )


PRICED = """
priced as (
  select sport, season, game_id, p as p_close, case when game_id % 5 <> 0 then p * 0.9 + 0.05 end as p_t1h,
    case when game_id % 3 <> 0 then p * 0.8 + 0.1 end as p_t6h, case when game_id % 2 <> 0 then p * 0.5 + 0.25 end as p_t24h,
    case when game_id % 11 <> 0 then o_totalprice end as volume, game_id % 13 = 0 as stale_flat_run
  from (select g.*, o.o_totalprice, round(cast((cast(g.game_id * 7919 % 1000 as double) + 0.5) / 1000.0 * 0.8 + 0.1 + case when g.winner = 'home' then 0.1 else -0.1 end * 0.8 as double), 6) as p
        from games g join orders o on o.o_orderkey = g.game_id where o.o_orderstatus <> 'P')
)"""


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("game_id") % 3 == 0, "no_market").when(F.col("game_id") % 3 == 1, "no_history").otherwise("no_quote")
    return _outcomes(spark, sf_dir).where("o_orderstatus = 'P'").select("sport", "season", "game_id", reason.alias("reason"))


MISSES = """
misses as (
  select g.sport, g.season, g.game_id, case g.game_id % 3 when 0 then 'no_market' when 1 then 'no_history' else 'no_quote' end as reason
  from games g join orders o on o.o_orderkey = g.game_id where o.o_orderstatus = 'P'
)"""


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes recovered for half of the games that lack one."""
    return games(spark, sf_dir).where("game_id % 22 = 0").select("sport", "season", "game_id", (F.col("game_id") * 1.5).alias("volume_recovered"), F.lit("patch").alias("volume_source"))


PATCH = "patch as (select sport, season, game_id, game_id * 1.5 as volume_recovered, 'patch' as volume_source from games where game_id % 22 = 0)"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.when(u % 2 == 0, "nba").otherwise("nhl").alias("sport"), F.lit("2024").alias("season"), u.alias("game_id"), F.col("event_type").alias("side"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), F.round(F.col("value") / (1 + F.col("value")), 2).alias("p"))


QUOTES = """
quotes as (
  select case when user_id % 2 = 0 then 'nba' else 'nhl' end as sport, '2024' as season, user_id as game_id, event_type as side,
    cast(floor(epoch(ts)) as bigint) as t, round(value / (1 + value), 2) as p
  from events
)"""


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start for each game that has quotes, an hour apart by id."""
    return quotes(spark, sf_dir).select("sport", "season", "game_id").distinct().withColumn("tip_t", F.lit(TIP) + F.col("game_id") % 24 * 3600)


STARTS = f"starts as (select distinct sport, season, game_id, {TIP} + game_id % 24 * 3600 as tip_t from quotes)"


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), n.cast("string")).alias("team"), (25.0 + n).cast("double").alias("lat"), (-120.0 + 2.0 * n).alias("lon"), (-8.0 + n % 4).cast("double").alias("tz_offset_std"))
    return rows.select(F.explode(F.array(F.lit("nba"), F.lit("nhl"))).alias("sport"), "*")


VENUES = """
venues as (
  select s.sport, 't' || cast(n_nationkey as varchar) as team, cast(25.0 + n_nationkey as double) as lat, cast(-120.0 + 2.0 * n_nationkey as double) as lon, cast(-8.0 + n_nationkey % 4 as double) as tz_offset_std
  from nation cross join (values ('nba'), ('nhl')) s(sport)
)"""


def with_sql(body: str, *parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n" + body
