"""Every operator applied to the given tables, each beside the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import analysis as Y
from plumbline.operators import anchors as A
from plumbline.operators import features as P
from plumbline.operators import frame as R
from plumbline.operators import outcomes as O
from plumbline.operators import scores as C
from plumbline.operators import series as Q
from plumbline.operators.asof import asof_join
from plumbline.plans import domain as D
from plumbline.plans.domain import GAMES, MISSES, PATCH, PRICED, QUOTES, STARTS, VENUES, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BOOKS = (GAMES, PRICED, MISSES)
TICKS = (QUOTES, STARTS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def look(spark: SparkSession, d: str) -> DataFrame:
    """Closing prices with outcomes."""
    return R.look(R.analysis_frame(D.priced(spark, d), D.games(spark, d)), "p_close")


LOOK = "looked as (select p.sport, p.season, p.game_id, g.et_date, p.p_close as p, case when g.winner = 'home' then 1.0 else 0.0 end as y, p.volume from priced p join games g using (sport, season, game_id) where p.p_close is not null)"


def _anchor_sql() -> str:
    parts = []
    for name, seconds in (("close", 0), ("t1h", 3600), ("t6h", 21600), ("t24h", 86400)):
        parts.append(f"arg_max(p, t + p / 2) filter (where t <= tip_t - {seconds} and p is not null) as p_{name}, max(t) filter (where t <= tip_t - {seconds} and p is not null) as t_{name}")
    # of ticks in one second the one with the largest price counts, in both engines
    return with_sql("select sport, season, game_id, side, max(tip_t) as tip_t, count(*) filter (where t <= tip_t and p is not null) as n_pre_tipoff, " + ", ".join(parts) + " from quotes join starts using (sport, season, game_id) group by all", QUOTES, STARTS)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, one for each series and second."""
    return D.quotes(spark, d).groupBy("sport", "season", "game_id", "side", "t").agg(F.max("p").alias("p"))


TICKS_ONE = "ticks as (select sport, season, game_id, side, t, max(p) as p from quotes group by all)"


@query(_anchor_sql())
def anchors_wide(spark: SparkSession, d: str) -> DataFrame:
    return A.anchors_wide(D.quotes(spark, d), D.starts(spark, d))


_LONG = "wide as (select * from (" + _anchor_sql() + "))"
_UNPIVOT = " union all ".join(f"select sport, season, game_id, side, tip_t, n_pre_tipoff, '{n}' as horizon, cast({s} as bigint) as horizon_secs, t_{n} as quote_t, p_{n} as p from wide" for n, s in (("close", 0), ("t1h", 3600), ("t6h", 21600), ("t24h", 86400)))


@query(with_sql(f"select *, tip_t - quote_t as secs_before_tip from ({_UNPIVOT}) where p is not null", _LONG))
def anchors_long(spark: SparkSession, d: str) -> DataFrame:
    return A.anchors_long(A.anchors_wide(D.quotes(spark, d), D.starts(spark, d)))


_PROBES = "probes as (select distinct sport, season, game_id, side, tip_t - 3600 * (game_id % 30) as as_of from ticks join starts using (sport, season, game_id))"


def probes(spark: SparkSession, d: str) -> DataFrame:
    keyed = ticks(spark, d).select("sport", "season", "game_id", "side").distinct().join(D.starts(spark, d), ["sport", "season", "game_id"])
    return keyed.withColumn("as_of", F.col("tip_t") - 3600 * (F.col("game_id") % 30)).drop("tip_t")


@query(
    with_sql(
        "select sport, season, game_id, side, as_of, horizon, quote_t, p from ("
        "select b.*, l.horizon, l.quote_t, l.p, row_number() over (partition by b.sport, b.season, b.game_id, b.side order by l.quote_t desc nulls last, l.horizon_secs desc nulls last) as n "
        "from probes b left join long l on b.sport = l.sport and b.season = l.season and b.game_id = l.game_id and b.side = l.side and b.as_of >= l.quote_t) where n = 1",
        QUOTES, STARTS, TICKS_ONE, _LONG, f"long as (select * from ({_UNPIVOT}) where p is not null)", _PROBES,
    )
)
def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    return A.price_as_of(anchors_long(spark, d), probes(spark, d))


_APP = "app as (select sport, season, game_id, et_date, start_t, winner, neutral_site as neutral, home as host, away as team, 'away' as side from games union all select sport, season, game_id, et_date, start_t, winner, neutral_site, home, home, 'home' from games)"


@query(
    with_sql(
        "select sport, season, game_id, team, prev_game from (select t.sport, t.season, t.game_id, t.team, b.game_id as prev_game, "
        "row_number() over (partition by t.sport, t.season, t.team, t.game_id order by b.start_t desc nulls last, b.game_id desc nulls last) as n "
        "from app t left join app b on t.sport = b.sport and t.season = b.season and t.team = b.team and b.start_t < t.start_t) where n = 1",
        GAMES, _APP,
    )
)
def asof_strict_previous(spark: SparkSession, d: str) -> DataFrame:
    rows = P.by_team(P.neutral(D.games(spark, d), None), "start_t").select("sport", "season", "game_id", "team", "start_t")
    before = rows.select("sport", "season", "team", F.col("start_t").alias("b_t"), F.col("game_id").alias("prev_game"))
    return asof_join(rows, before, ["sport", "season", "team"], "start_t", "b_t", strict=True, take=["prev_game"], tie=["prev_game"]).drop("start_t")


@query(
    with_sql(
        "select sport, season, game_id, t, p, t_other from (select a.sport, a.season, a.game_id, a.t, a.p, case when a.t - b.t <= 7200 then b.t end as t_other, "
        "row_number() over (partition by a.sport, a.season, a.game_id, a.t order by b.t desc nulls last) as n from "
        "(select * from ticks where side = 'click') a left join (select * from ticks where side = 'view') b "
        "on a.sport = b.sport and a.season = b.season and a.game_id = b.game_id and b.t <= a.t) where n = 1",
        QUOTES, TICKS_ONE,
    )
)
def asof_with_tolerance(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    a, b = (t.where(F.col("side") == s).drop("side") for s in ("click", "view"))
    return asof_join(a, b.select("sport", "season", "game_id", F.col("t").alias("t_other")), ["sport", "season", "game_id"], "t", "t_other", strict=False, take=["t_other"], tolerance=7200)


@query(
    with_sql(
        "select sport, season, game_id, count(*) as pairs, count(*) filter (where abs(p + p_other - 1) < 0.000001) as fitting, "
        "case when count(*) >= 10 then count(*) filter (where abs(p + p_other - 1) < 0.000001) >= 0.5 * count(*) end as complement_ok from ("
        "select a.sport, a.season, a.game_id, a.t, a.p, b.p as p_other, a.t - b.t as gap, row_number() over (partition by a.sport, a.season, a.game_id, a.t order by b.t desc nulls last) as n from "
        "(select ticks.*, tip_t from ticks join starts using (sport, season, game_id) where side = 'click' and t <= tip_t and t >= tip_t - 7200) a left join (select * from ticks where side = 'view') b "
        "on a.sport = b.sport and a.season = b.season and a.game_id = b.game_id and b.t <= a.t) where n = 1 and gap <= 60 group by all",
        QUOTES, STARTS, TICKS_ONE,
    )
)
def complementarity(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    home = t.where("side = 'click'").drop("side").join(D.starts(spark, d), ["sport", "season", "game_id"])
    return Q.complementarity(home, t.where("side = 'view'").drop("side"), ["sport", "season", "game_id"])


def _features_sql() -> str:
    delay = "case sport when 'nba' then 8400 else 9000 end"
    return with_sql(
        """select h.sport, h.season, h.game_id, h.et_date, h.as_of, h.neutral, a.team as away, h.team as home, {sides},
  h.rest_days - a.rest_days as rest_days_diff, round(h.travel_km - a.travel_km, 6) as travel_km_diff, h.games_7d - a.games_7d as games_7d_diff, round(h.win_rate - a.win_rate, 6) as win_rate_diff
from (select * from side_values where side = 'home') h join (select * from side_values where side = 'away') a using (sport, season, game_id)""".format(
            sides=", ".join(f"{'round(' * (c in ('travel_km', 'win_rate'))}{s[0]}.{c}{', 6)' * (c in ('travel_km', 'win_rate'))} as {s}_{c}" for s in ("away", "home") for c in ("rest_days", "b2b", "first_of_season", "travel_km", "tz_shift", "travel_known", "games_7d", "prior_games", "prior_settled", "win_rate"))
        ),
        GAMES,
        VENUES,
        _APP,
        "asked as (select *, start_t - 3600 as as_of from app)",
        """previous as (select * from (select t.sport, t.season, t.game_id, t.side, t.team, t.host, t.neutral, t.et_date, t.as_of, b.et_date as prev_date, b.host as prev_host, b.neutral as prev_neutral,
  row_number() over (partition by t.sport, t.season, t.game_id, t.side order by b.start_t desc nulls last, b.game_id desc nulls last) as n
  from asked t left join app b on t.sport = b.sport and t.season = b.season and t.team = b.team and b.start_t < t.as_of) where n = 1)""",
        f"""history as (select t.sport, t.season, t.game_id, t.side, count(b.game_id) as prior_games,
  count(*) filter (where b.start_t + {delay.replace('sport', 't.sport')} <= t.as_of) as prior_settled,
  count(*) filter (where b.start_t + {delay.replace('sport', 't.sport')} <= t.as_of and b.winner = b.side) as prior_wins,
  count(*) filter (where b.start_t >= t.as_of - 604800) as games_7d
  from asked t left join app b on t.sport = b.sport and t.season = b.season and t.team = b.team and b.start_t < t.as_of group by all)""",
        """side_values as (select p.*, h.prior_games, h.prior_settled, h.games_7d,
  date_diff('day', prev_date, et_date) as rest_days, date_diff('day', prev_date, et_date) = 1 as b2b, prev_date is null as first_of_season,
  prev_date is not null and not neutral and not coalesce(prev_neutral, true) as travel_known,
  case when prev_date is not null and not neutral and not prev_neutral then 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(v.lat) - radians(w.lat)) / 2), 2) + cos(radians(w.lat)) * cos(radians(v.lat)) * pow(sin((radians(v.lon) - radians(w.lon)) / 2), 2)))) end as travel_km,
  case when prev_date is not null and not neutral and not prev_neutral then v.tz_offset_std - w.tz_offset_std end as tz_shift,
  case when h.prior_settled > 0 then h.prior_wins / h.prior_settled end as win_rate
  from previous p join history h using (sport, season, game_id, side) left join venues v on v.sport = p.sport and v.team = p.host left join venues w on w.sport = p.sport and w.team = p.prev_host)""",
    )


@query(_features_sql())
def point_in_time_features(spark: SparkSession, d: str) -> DataFrame:
    games = D.games(spark, d)
    return rounded(P.assemble(games, P.backtest_targets(games, 3600), D.venues(spark, d), check=False))


@query(with_sql("select sport, season, game_id, '' as only_in from games where false", GAMES))
def leakage_canary(spark: SparkSession, d: str) -> DataFrame:
    """No row: nothing that comes after the as-of time changes a feature."""
    games, at = D.games(spark, d), 904608000
    slate = games.where(f"start_t >= {at} and start_t < {at} + 864000")
    return P.canary(games, slate, D.venues(spark, d), at).select("sport", "season", "game_id", "only_in")


@query(with_sql("select sport, season, count(*) as scheduled, count(*) filter (where k = 'p') as priced, count(*) filter (where k = 'm') as missed, count(*) - count(*) filter (where k in ('p', 'm')) as gap from (select g.*, case when p.game_id is not null then 'p' when m.game_id is not null then 'm' end as k from games g left join priced p using (sport, season, game_id) left join misses m using (sport, season, game_id)) group by all", *BOOKS))
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return O.reconcile(D.games(spark, d), D.priced(spark, d), D.misses(spark, d))


@query(with_sql("select sport, season, game_id from priced where game_id in (select game_id from misses union select game_id from games where game_id % 500 = 0)", *BOOKS))
def double_counted(spark: SparkSession, d: str) -> DataFrame:
    """Against misses to which some games were added by mistake."""
    wrong = D.misses(spark, d).select("sport", "season", "game_id").unionByName(D.games(spark, d).where("game_id % 500 = 0").select("sport", "season", "game_id"))
    return O.double_counted(D.priced(spark, d), wrong)


@query(with_sql("select sport, season, game_id from priced where game_id % 100 = 7", *BOOKS))
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of games that a shortened schedule lacks."""
    return O.orphans(D.priced(spark, d), D.games(spark, d).where("game_id % 100 <> 7")).select("sport", "season", "game_id")


@query(with_sql("select (select count(*) from quotes) as points, (select count(*) from (select distinct sport, season, game_id, side from quotes)) as series, (select count(*) from starts where game_id not in (select game_id from quotes where side = 'click')) as missing_series, (select count(*) from starts where game_id >= 100) as orphan_series", *TICKS))
def points_summary(spark: SparkSession, d: str) -> DataFrame:
    games = D.starts(spark, d)
    found = O.points_summary(D.quotes(spark, d), games, "click").drop("orphan_series")
    return found.crossJoin(O.points_summary(D.quotes(spark, d), games.where("game_id < 100"), "click").select("orphan_series"))


@query(with_sql("select sport, count(*) as n from (select sport, season, game_id from priced union select sport, season, game_id from misses) group by sport", *BOOKS))
def settled_union(spark: SparkSession, d: str) -> DataFrame:
    return O.counts_by(O.settled(D.priced(spark, d), D.misses(spark, d)), "sport")


@query(with_sql("select sport, season, game_id from misses", *BOOKS))
def lost_games(spark: SparkSession, d: str) -> DataFrame:
    return O.lost(D.games(spark, d), D.priced(spark, d))


@query(with_sql("select sport, reason, count(*) as n from misses group by all", *BOOKS))
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    return O.counts_by(D.misses(spark, d), "sport", "reason")


@query(with_sql("select g.sport, strftime(g.et_date, '%Y-%m') as month, count(*) as scheduled, count(p.game_id) as attempted from games g left join priced p using (sport, season, game_id) group by all", *BOOKS))
def attempted_by_month(spark: SparkSession, d: str) -> DataFrame:
    return O.attempted_by_month(D.games(spark, d), D.priced(spark, d))


_WEEKS = "weeks as (select *, cast(date_diff('day', min(et_date) over (partition by sport, season), et_date) // 7 as int) + 1 as week_of_season from games)"


@query(with_sql("select w.sport, w.season, w.week_of_season, count(*) as scheduled, count(p.game_id) as priced, count(m.game_id) as missed, min(w.et_date) as first_date, round(median(p.volume), 6) as median_volume from weeks w left join priced p using (sport, season, game_id) left join misses m using (sport, season, game_id) group by all", *BOOKS, _WEEKS))
def coverage_by_week(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.coverage_by_week(D.games(spark, d), D.priced(spark, d), D.misses(spark, d)))


_FRAME = "frame as (select p.sport, p.season, p.game_id, w.et_date, w.week_of_season, coalesce(p.volume, x.volume_recovered) as volume, case when p.volume is not null then 'market' when x.volume_recovered is not null then x.volume_source else 'absent' end as volume_source, p.p_close, p.p_t1h, p.p_t6h, p.p_t24h, p.stale_flat_run, case when w.winner = 'home' then 1.0 else 0.0 end as y from priced p join weeks w using (sport, season, game_id) left join patch x using (sport, season, game_id))"
_FRAME_PARTS = (*BOOKS, PATCH, _WEEKS, _FRAME)


def frame_of(spark: SparkSession, d: str) -> DataFrame:
    return R.analysis_frame(D.priced(spark, d), D.games(spark, d), D.patch(spark, d))


@query(with_sql("select * replace (round(volume, 6) as volume, round(p_close, 6) as p_close, round(p_t1h, 6) as p_t1h, round(p_t6h, 6) as p_t6h, round(p_t24h, 6) as p_t24h, cast(y as double) as y) from frame", *_FRAME_PARTS))
def analysis_frame(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frame_of(spark, d))


@query(with_sql("select sport, season, count(*) as games, count(p_close) as n_p_close, count(p_t1h) as n_p_t1h, count(p_t6h) as n_p_t6h, count(p_t24h) as n_p_t24h from frame group by all", *_FRAME_PARTS))
def look_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.look_coverage(frame_of(spark, d))


_STRATA = (
    "phased as (select *, case when week_of_season <= median(week_of_season) over (partition by sport, season) then 'early' else 'late' end as phase from frame)",
    "strata as (select *, case when volume is null then null when volume <= median(volume) over (partition by sport, season, phase) then 'low' else 'high' end as liquidity from phased)",
)


@query(with_sql("select sport, season, game_id, phase, liquidity from strata", *_FRAME_PARTS, *_STRATA))
def strata(spark: SparkSession, d: str) -> DataFrame:
    return R.assign_strata(frame_of(spark, d)).select("sport", "season", "game_id", "phase", "liquidity")


@query(with_sql("select sport, season, phase, liquidity, count(*) as n, round(avg(p_close), 6) as mean_p, round(avg(y), 6) as rate, round(avg(power(p_close - y, 2)), 6) as brier from strata where liquidity is not null group by all", *_FRAME_PARTS, *_STRATA))
def cell_table(spark: SparkSession, d: str) -> DataFrame:
    rows = R.assign_strata(frame_of(spark, d)).where("liquidity is not null")
    return rounded(rows.groupBy("sport", "season", "phase", "liquidity").agg(F.count(F.lit(1)).alias("n"), F.avg("p_close").alias("mean_p"), F.avg("y").alias("rate"), F.avg(S.squared_error("p_close", "y")).alias("brier")))


@query(with_sql("select sport, season, game_id, side, count(*) as n, sum(t) as sum_t, round(sum(round(p, 6)), 4) as sum_p from quotes group by all", *TICKS))
def series_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return O.series_fingerprint(D.quotes(spark, d))


@query()
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return O.content_digest(D.priced(spark, d))


@query(with_sql("select sport, season, game_id, side, count(*) as points, count(*) filter (where b is not null and p <> b) as changes, min(t) as first_t from (select *, lag(p) over (partition by sport, season, game_id, side order by t, p) as b from quotes) group by all", *TICKS))
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return Q.price_changes(D.quotes(spark, d), A.KEYS)


@query(with_sql("select sport, season, game_id, side, count(*) = 4 and min(p) = max(p) as stale_flat_run from (select *, row_number() over (partition by sport, season, game_id, side order by t desc, p desc) as n from flat) where n <= 4 group by all", *TICKS, "flat as (select sport, season, game_id, side, t, round(p, 1) as p from quotes)"))
def stale_flat_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs of four prices, as the given series are short and lively."""
    return Q.stale_flat_run(D.quotes(spark, d).withColumn("p", F.round("p", 1)), A.KEYS, 4)


@query(with_sql("select sport, season, game_id, team, count(*) over (partition by sport, season, team order by start_t range between 604800 preceding and 1 preceding) as games_7d, count(*) over (partition by sport, season, team order by start_t range between unbounded preceding and 1 preceding) as prior_games from app", GAMES, _APP))
def rolling_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = P.by_team(P.neutral(D.games(spark, d), None), "start_t")
    by = Window.partitionBy("sport", "season", "team").orderBy("start_t")
    return rows.select("sport", "season", "game_id", "team", F.count(F.lit(1)).over(by.rangeBetween(-P.DENSITY_SECONDS, -1)).alias("games_7d"), F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, -1)).alias("prior_games"))


@query(with_sql("select sport, season, game_id, week_of_season from weeks", GAMES, _WEEKS))
def week_of_season(spark: SparkSession, d: str) -> DataFrame:
    return R.with_week(D.games(spark, d)).select("sport", "season", "game_id", "week_of_season")


_LOOKED = (*BOOKS, LOOK)
_LL = "-(y * ln(q) + (1 - y) * ln(1 - q))"


@query(with_sql(f"select sport, count(*) as n, round(avg(power(p - y, 2)), 6) as brier, round(avg({_LL}), 6) as log_loss, round(avg({_LL.replace('q', 'c')}), 6) as clipped_log_loss from (select *, greatest(least(p, 1 - 1e-15), 1e-15) as q, greatest(least(p, 0.99), 0.01) as c from looked) group by sport", *_LOOKED))
def score_set(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.score_set(look(spark, d), ["sport"]))


_BINNED = "binned as (select *, cast((n * 10 - 1) // total as int) as bin from (select *, row_number() over (partition by sport order by p, game_id) as n, count(*) over (partition by sport) as total from looked))"
_BINS = "bins as (select sport, bin, count(*) as n, avg(p) as mean_p, avg(y) as obs_rate, min(p) as p_lo, max(p) as p_hi from binned group by all)"


def bins_of(spark: SparkSession, d: str) -> DataFrame:
    return C.bin_table(C.equal_count_bins(look(spark, d), 10, ["sport"], ["game_id"]), ["sport"])


@query(with_sql("select sport, bin, n, round(mean_p, 6) as mean_p, round(obs_rate, 6) as obs_rate, round(p_lo, 6) as p_lo, round(p_hi, 6) as p_hi from bins", *_LOOKED, _BINNED, _BINS))
def equal_count_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bins_of(spark, d))


@query(with_sql("select bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as obs_rate from (select *, cast((row_number() over (order by p, game_id) * 7 - 1) // count(*) over () as int) as bin from looked) group by bin", *_LOOKED))
def equal_count_bins_global(spark: SparkSession, d: str) -> DataFrame:
    """Over the whole table, ranked without a task that sees all of it."""
    return rounded(C.bin_table(C.equal_count_bins(look(spark, d), 7, (), ["game_id"])).select("bin", "n", "mean_p", "obs_rate"))


@query(with_sql("select sport, round(sum(abs(mean_p - obs_rate) * n) / sum(n), 6) as ece, round(max(abs(mean_p - obs_rate)), 6) as max_bin_dev, cast(sum(n) as bigint) as n from bins group by sport", *_LOOKED, _BINNED, _BINS))
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.calibration_error(bins_of(spark, d), ["sport"]))


@query(with_sql("select sport, round(rel, 6) as reliability, round(res, 6) as resolution, round(base * (1 - base), 6) as uncertainty, round(rel - res + base * (1 - base), 6) as brier_binned from (select sport, sum(obs_rate * n) / sum(n) as base, sum(power(mean_p - obs_rate, 2) * n) / sum(n) as rel, sum(power(obs_rate, 2) * n) / sum(n) - power(sum(obs_rate * n) / sum(n), 2) as res from bins group by sport)", *_LOOKED, _BINNED, _BINS))
def murphy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.murphy(bins_of(spark, d), ["sport"]))


_CURVE = [0.2, 0.35, 0.5, 0.65, 0.8]


@query(with_sql("select sport, cast((p >= 0.2)::int + (p >= 0.35)::int + (p >= 0.5)::int + (p >= 0.65)::int + (p >= 0.8)::int as bigint) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as obs_rate, round(min(p), 6) as p_lo, round(max(p), 6) as p_hi from looked group by all", *_LOOKED))
def binned_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.binned_curve(look(spark, d), _CURVE, ["sport"])).withColumn("bin", F.col("bin").cast("long"))


@query(with_sql("select unnest([1, 2, 3, 4]) as i, round(unnest(quantile_cont(p, [0.2, 0.4, 0.6, 0.8])), 6) as edge from looked", *_LOOKED))
def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = C.quantile_edges(look(spark, d), 5)
    return rounded(spark.createDataFrame([(i + 1, e) for i, e in enumerate(edges)], "i int, edge double"))


@query(with_sql("select sport, round(corr(ra, rb), 6) as rho, count(*) as n from (select sport, rank() over (partition by sport order by a) + (count(*) over (partition by sport, a) - 1) / 2.0 as ra, rank() over (partition by sport order by b) + (count(*) over (partition by sport, b) - 1) / 2.0 as rb from (select sport, round(p, 2) as a, round(volume, -4) as b from looked where volume is not null)) group by sport", *_LOOKED))
def spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = look(spark, d).select("sport", F.round("p", 2).alias("a"), F.round("volume", -4).alias("b"))
    return rounded(C.spearman(rows, "a", "b", ["sport"]))


@query(with_sql("select sport, count(*) as n, round(avg(p) filter (where y = 1) - avg(p) filter (where y = 0), 6) as gap, round((avg(p) filter (where y = 1) - avg(p) filter (where y = 0)) / sqrt(var_pop(p) filter (where y = 1) / count(*) filter (where y = 1) + var_pop(p) filter (where y = 0) / count(*) filter (where y = 0)), 5) as sigmas from looked group by sport", *_LOOKED))
def discrimination(spark: SparkSession, d: str) -> DataFrame:
    out = C.discrimination(look(spark, d), ["sport"])
    return out.select("sport", "n", F.round("gap", 6).alias("gap"), F.round("sigmas", 5).alias("sigmas"))


@query(with_sql("select sport, round(avg(case when p between 0.35 and 0.65 then 1.0 else 0.0 end), 6) as near_half, round(avg(p * (1 - p)), 6) as mean_variance, round(min(p), 6) as p_min, round(max(p), 6) as p_max, round(stddev_pop(ln(p / (1 - p))), 6) as sd_logit, round(avg(abs(p - 0.5)), 6) as mean_distance from looked group by sport", *_LOOKED))
def pool_shape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.pool_shape(look(spark, d), ["sport"]))


@query(with_sql("select sport, count(*) as n, round(avg(y), 6) as home_rate, round(avg(y) * (1 - avg(y)), 6) as brier_rate, round(-(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))), 6) as log_loss_rate, cast(0.25 as double) as brier_coin, round(ln(2.0), 6) as log_loss_coin from looked group by sport", *_LOOKED))
def baselines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.baselines(look(spark, d), ["sport"]))


@query(with_sql(f"select sport, count(*) as n, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, round(avg(power(p - y, 2)), 6) as brier, round(avg({_LL.replace('q', 'p')}), 6) as log_loss, round(sum(greatest(p, 1 - p)), 4) as expected_right from looked group by sport", *_LOOKED))
def forecast_grades(spark: SparkSession, d: str) -> DataFrame:
    out = C.graded(look(spark, d), ["sport"])
    return out.select("sport", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss")), F.round("expected_right", 4).alias("expected_right"))


_MODEL = "modelled as (select *, p + (game_id % 31 - 15) / 150.0 as m from looked)"


def modelled(spark: SparkSession, d: str) -> DataFrame:
    """A forecast that departs from the price by up to 0.1."""
    return look(spark, d).withColumn("m", F.col("p") + (F.col("game_id") % 31 - 15) / 150.0)


@query(with_sql("select tier, count(*) as n, round(avg(case when m > p then y else 1 - y end), 6) as hit_rate, round(avg(abs(m - p)), 6) as mean_edge, round(avg(power(m - y, 2)), 6) as brier_model, round(avg(power(p - y, 2)), 6) as brier_market from (select *, case when abs(m - p) >= 0.1 then 'T3' when abs(m - p) >= 0.05 then 'T2' when abs(m - p) >= 0.02 then 'T1' end as tier from (select sport, y, round(m, 9) as m, round(p, 9) as p from modelled)) where tier is not null group by tier", *_LOOKED, _MODEL))
def risk_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = modelled(spark, d).select("y", F.round("m", 9).alias("m"), F.round("p", 9).alias("p"))
    return rounded(C.risk_tiers(rows, "m", "p"))


@query(with_sql("select bucket, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as obs_rate from (select *, case when p < 0.2 then null when p < 0.4 then 0 when p < 0.6 then 1 when p < 0.9 then 2 when p <= 1 then 3 end as bucket from looked) where bucket is not null group by bucket", *_LOOKED))
def reliability_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.reliability_buckets(look(spark, d), [0.2, 0.4, 0.6, 0.9, 1.0]))


@query(with_sql("select sport, count(*) as n, round(avg(f), 6) as mean_term, round(stddev_samp(f) / sqrt(count(*)), 6) as se, round(avg(f) / (stddev_samp(f) / sqrt(count(*))), 4) as z from (select sport, power(p - y, 2) - (power(m - y, 2) - power(p - m, 2)) as f from modelled) group by sport", *_LOOKED, _MODEL))
def clark_west(spark: SparkSession, d: str) -> DataFrame:
    out = C.clark_west(modelled(spark, d), "p", "m", by=["sport"])
    return out.select("sport", "n", F.round("mean_term", 6).alias("mean_term"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"))


@query(with_sql("select distinct g.sport, g.season, g.game_id from games g join games h on g.sport = h.sport and g.away = h.away and g.home = h.home and h.et_date = g.et_date + 1", GAMES))
def rematches(spark: SparkSession, d: str) -> DataFrame:
    return O.rematches(D.games(spark, d)).select("sport", "season", "game_id")


@query(with_sql("select sport, season, game_id from (select *, row_number() over (partition by sport, season order by et_date, game_id) - 1 as n, count(*) over (partition by sport, season) as total from games) where n in (select (i * total) // 20 from range(20) r(i)) or total <= 20", GAMES))
def stride_slice(spark: SparkSession, d: str) -> DataFrame:
    return O.slice_games(D.games(spark, d), 20, "stride").select("sport", "season", "game_id")


@query("select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as label, contains(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g')) as matches from part")
def label_matching(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "part").select("p_partkey", S.normalised_label("p_name").alias("label"), S.labels_match(F.array(F.concat_ws(" ", "p_name", "p_brand")), "p_brand").alias("matches"))


@query("select c_custkey, case when count(*) over (partition by c_mktsegment, place) = 1 then place end as unique_place from (select *, cast(c_nationkey as varchar) || '-' || cast(cast(floor(c_acctbal / 100) as int) as varchar) as place from customer)")
def unique_places(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "customer").withColumn("place", F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 100).cast("int").cast("string")))
    return O.unique_places(rows, by=["c_mktsegment"]).select("c_custkey", "unique_place")


@query(with_sql("select game_id, sport || '-' || away || '-' || home || '-' || strftime(et_date, '%Y-%m-%d') as slug, away as parsed_away, et_date as parsed_date from games", GAMES))
def slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = D.games(spark, d).select("game_id", S.slug("sport", "away", "home", "et_date").alias("slug"))
    parsed = S.parse_slug("slug")
    return rows.select("game_id", "slug", parsed["away"].alias("parsed_away"), parsed["date"].alias("parsed_date"))


@query(with_sql("select a.sport, a.team as team_a, b.team as team_b, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 6) as km from venues a join venues b on a.sport = b.sport and a.team < b.team", VENUES))
def distances(spark: SparkSession, d: str) -> DataFrame:
    v = D.venues(spark, d)
    a, b = (v.select("sport", *(F.col(c).alias(f"{c}_{s}") for c in ("team", "lat", "lon"))) for s in "ab")
    return a.join(b, "sport").where("team_a < team_b").select("sport", "team_a", "team_b", F.round(S.haversine_km("lat_a", "lon_a", "lat_b", "lon_b"), 6).alias("km"))


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, cast(json_extract(props, '$.k') as int) between 0 and 50 as in_range from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "struct<k:int>")["k"]
    return D.table(spark, d, "events").select("event_id", k.alias("k"), k.between(0, 50).alias("in_range"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return O.latest(D.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select event_id, substr(sha256(cast(user_id as varchar) || '|' || event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')), 1, 32) as dedup_key from events")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "events")
    return rows.select("event_id", S.dedup_key("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("dedup_key"))


_EAST = "(ts - interval 5 hour)"  # the given events are all in winter


@query(f"select event_id, (hour{_EAST} * 60 + minute{_EAST} >= 960) or (hour{_EAST} * 60 + minute{_EAST} <= 150) as polled from events")
def poll_window(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select("event_id", S.in_poll_window(F.col("ts").cast("timestamp")).alias("polled"))


@query(f"select cast({_EAST} as date) as et_date, count(*) as captured from events group by 1")
def captured_on(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.streaming.collector import captured_on as by_date

    return by_date(D.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("captured_at")))


@query(with_sql("select sport, season, game_id, poll_seq, round(sum(p), 6) as total, count(p) as sides, case when count(p) = 2 then abs(sum(p) - 1) <= 0.02 end as ok from (select *, t // 86400 as poll_seq from ticks where side in ('click', 'view')) group by all", QUOTES, TICKS_ONE))
def live_complement(spark: SparkSession, d: str) -> DataFrame:
    rows = ticks(spark, d).where("side in ('click', 'view')").select("sport", "season", "game_id", F.expr("t div 86400").alias("poll_seq"), F.col("p").alias("midpoint"))
    return rounded(Q.live_complement(rows, 0.02))


@query(with_sql("select sport, season, game_id, case when game_id % 50 = 1 then 'missing' when game_id % 50 = 2 then 'changed' end as kind from games where game_id % 50 in (1, 2) union all select sport, season, game_id + 10000000, 'extra' from games where game_id % 500 = 3", GAMES))
def difference_three_ways(spark: SparkSession, d: str) -> DataFrame:
    want = D.games(spark, d).select("sport", "season", "game_id", "home")
    got = want.where("game_id % 50 <> 1").withColumn("home", F.when(F.col("game_id") % 50 == 2, "elsewhere").otherwise(F.col("home")))
    extra = want.where("game_id % 500 = 3").withColumn("game_id", F.col("game_id") + 10000000)
    return O.difference(got.unionByName(extra), want, ["sport", "season", "game_id"], ["home"])


_GRID = "cross join (values (0.01), (0.02), (0.03)) h(half_spread) cross join (values (0.0), (0.05)) f(fee)"


@query(with_sql(f"select half_spread, fee, count(*) as bets, round(sum(case when y = 1 then 1 / paid - 1 else -1 end), 4) as profit, round(avg(case when y = 1 then 1 / paid - 1 else -1 end), 6) as roi from (select cast(half_spread as double) as half_spread, cast(fee as double) as fee, m, y, p + half_spread + fee * p * (1 - p) as paid from modelled {_GRID}) where m > paid and paid < 1 group by all", *_LOOKED, _MODEL))
def prize_grid(spark: SparkSession, d: str) -> DataFrame:
    return Y.prize(modelled(spark, d), "m").withColumns({"profit": F.round("profit", 4), "roi": F.round("roi", 6)})


@query(with_sql("select sport, season, game_id from (select *, row_number() over (partition by sport, season order by sha256(concat_ws('|', '23', sport, season, cast(game_id as varchar)))) as k from games) where k <= 100", GAMES))
def random_games(spark: SparkSession, d: str) -> DataFrame:
    return O.random_games(D.games(spark, d), 100).select("sport", "season", "game_id")


_TOLD = " ".join(f"when {k} then '{r}'" for k, r in enumerate(("no_moneyline_market", "label_mismatch_at_slug", "no_market", "implausible_game_start_time", "unparseable_market", "missing_gameStartTime", "unparseable_gameStartTime", "no_pre_tipoff_points", "complementarity_failed")))


@query(with_sql(f"select sport, coalesce(reason, 'priced') as reason, count(*) as n from (select sport, case game_id % 15 {_TOLD} when 10 then 'postponed_or_split_resolution' when 11 then 'outcome_prices_not_complementary' when 12 then 'malformed_outcome_prices' when 13 then 'unresolved_market' when 14 then 'label_disagreement' end as reason from games) group by all", GAMES))
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Each fifteenth of the games lacks one thing; one of them is priced."""
    k = F.col("game_id") % 15
    other = F.when(F.col("winner") == "home", "away").otherwise("home")
    rows = D.games(spark, d).select(
        "sport", "winner", (k > 2).alias("market"), (k < 2).alias("saw"), (k == 0).alias("partial"), (k != 3).alias("start_ok"), (k != 4).alias("parsed"), F.when(k == 5, " ").when(k == 6, "soon").otherwise("2025-01-01T00:00:00Z").alias("start"),
        F.when(k == 7, 0).otherwise(5).alias("points"), F.when(k == 8, False).when(k != 9, True).alias("complement"),
        F.when(k == 10, "tie").when(k == 11, "non_complementary").when(k == 12, "malformed").when(k == 14, other).when(k != 13, F.col("winner")).alias("resolved"),
    )
    reason = S.outcome_reason("market", "saw", "partial", "start_ok", "points", "complement", "resolved", "winner", "parsed", "start")
    return rows.groupBy("sport", F.coalesce(reason, F.lit("priced")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, generate_subscripts([1, 2, 3], 1) as i, unnest([1, 2, 3]) * user_id as t from (select distinct user_id from events)")
def array_zip_insert(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "events").select("user_id").distinct()
    arrays = rows.select("user_id", F.array(*map(F.lit, (1, 2, 3))).alias("p"), F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda x: x * F.col("user_id")).alias("t"))
    return Q.insert_series(arrays).select("user_id", F.col("p").alias("i"), "t")
