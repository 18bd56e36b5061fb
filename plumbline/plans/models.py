"""Queries of fits, walks and simulations; SQL stands beside those that it can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import analysis as Y
from plumbline.operators import cox as X
from plumbline.operators import elo as E
from plumbline.operators import features as P
from plumbline.operators import frame as R
from plumbline.operators import hierarchy as H
from plumbline.operators import ingest as I
from plumbline.operators import matching, resample
from plumbline.operators import model as M
from plumbline.operators import reports as T
from plumbline.operators import scores as C
from plumbline.plans import domain as D
from plumbline.plans.domain import GAMES, with_sql
from plumbline.plans.queries import _LOOKED, ORACLES, _features_sql, look, modelled, query, rounded
from plumbline.schemas import BUCKET_EDGES, NULL_TABLE, RATING_GRIDS, RATING_SETTINGS
from plumbline.sources.scratch import kept

SETTINGS = {s: E.Setting(*map(float, v)) for s, v in RATING_SETTINGS.items()}


def each_sport(run: Callable[[str], DataFrame]) -> DataFrame:
    """The results of all sports, each with its name."""
    return functools.reduce(DataFrame.unionByName, (run(s).withColumn("sport", F.lit(s)) for s in sorted(SETTINGS)))


def _newton_sql(by: str) -> str:
    """Ten Newton steps, unrolled; each is the solution of two equations whose five sums are aggregates."""
    key = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    join = f"using ({by})" if by else "on true"
    parts = ["logits as (select *, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) as x from looked)", f"step0 as (select {key}cast(ln(avg(y) / (1 - avg(y))) as double) as a, cast(0 as double) as b from logits{group})"]
    for i in range(10):
        sums = f"select {key}any_value(a) as a, any_value(b) as b, sum(mu - y) as g0, sum((mu - y) * x) as g1, sum(mu * (1 - mu)) as h0, sum(mu * (1 - mu) * x) as h1, sum(mu * (1 - mu) * x * x) as h2 from (select logits.*, a, b, 1 / (1 + exp(-(a + b * x))) as mu from logits join step{i} {join}){group}"
        parts.append(f"step{i + 1} as (select {key}a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b from ({sums}))")
    count = f"(select count(*) from looked l where l.{by} = step10.{by})" if by else "(select count(*) from looked)"
    return with_sql(f"select {key}{count} as n, round(b, 5) as slope, round(a, 5) as intercept from step10", *_LOOKED, *parts)


@query(_newton_sql("sport"))
def cox_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.cox_by(look(spark, d), ["sport"]).drop("failure"), 5)


@query(_newton_sql(""))
def cox_whole_table(spark: SparkSession, d: str) -> DataFrame:
    rows = look(spark, d)
    slope, intercept = X.cox_table(rows)
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept")), 5)


_NULLS = ", ".join(f"('{s}', {n}, {e}, {lo}, {hi})" for s, n, e, lo, hi in NULL_TABLE)


@query(with_sql("select sport, season, n, cast(ref_n as bigint) as ref_n, cast(ece_p99 as double) as ece_p99, cast(slope_lo as double) as slope_lo, cast(slope_hi as double) as slope_hi, n < ref_n as below_table from (select s.*, t.*exclude(sport), row_number() over (partition by s.sport, s.season order by t.ref_n <= s.n desc, case when t.ref_n <= s.n then -t.ref_n else t.ref_n end) as k from sizes s join t on s.sport = t.sport) where k = 1", *_LOOKED, f"t(sport, ref_n, ece_p99, slope_lo, slope_hi) as (values {_NULLS})", "sizes as (select sport, season, count(*) as n from looked group by all)"))
def null_reference(spark: SparkSession, d: str) -> DataFrame:
    return C.null_reference(look(spark, d).groupBy("sport", "season").agg(F.count(F.lit(1)).alias("n")))


def features_of(spark: SparkSession, d: str) -> DataFrame:
    games = D.games(spark, d)
    return P.assemble(games, P.backtest_targets(games, 3600), D.venues(spark, d), check=False)


_DESIGN = "design as (select f.*, case when g.winner = 'home' then 1.0 else 0.0 end as y, g.start_t from (" + _features_sql() + ") f join games g using (sport, season, game_id))"


@query(with_sql("select sport, game_id, (home_rest_days is null)::int + (away_rest_days is null)::int as filled, coalesce(cast(home_rest_days as double), (select median(home_rest_days) from design where season < '1998')) as home_rest_days, coalesce(cast(away_rest_days as double), (select median(away_rest_days) from design where season < '1998')) as away_rest_days from design", GAMES, _DESIGN))
def median_fill(spark: SparkSession, d: str) -> DataFrame:
    """Filled with medians of the seasons before 1998 alone."""
    columns = ["home_rest_days", "away_rest_days"]
    rows = kept(features_of(spark, d).select("sport", "season", "game_id", *columns), "features")  # for the medians and for the filling
    return M.fill(rows, M.medians(rows, columns, "season < '1998'")).select("sport", "game_id", "filled", *columns)


@query(with_sql("select sport, game_id, round((home_games_7d - (select avg(home_games_7d) from design where season < '1998')) / (select stddev_pop(home_games_7d) from design where season < '1998'), 6) as z_home_games_7d from design", GAMES, _DESIGN))
def standardised(spark: SparkSession, d: str) -> DataFrame:
    rows = features_of(spark, d)
    frozen = M.scaler(rows, ["home_games_7d"], "season < '1998'")
    return rounded(M.standardise(rows, frozen).select("sport", "game_id", "z_home_games_7d"))


@query(with_sql("select sport, game_id, cast(home_rest_days - away_rest_days as double) as rest_diff, cast(cast(home_b2b as int) - cast(away_b2b as int) as double) as b2b_diff, home_tz_shift - away_tz_shift as tz_diff from design", GAMES, _DESIGN))
def derived_terms(spark: SparkSession, d: str) -> DataFrame:
    return M.derive_terms(features_of(spark, d)).select("sport", "game_id", "rest_diff", "b2b_diff", "tz_diff")


ORIGINS = [852076800, 883612800, 915148800]  # 1997, 1998, 1999


@query(with_sql("select sport, fold, role, count(*) as n from (select sport, fold, case when start_t < o then 'train' when start_t < e then 'test' end as role from games cross join (values (0, 852076800, 883612800), (1, 883612800, 915148800), (2, 915148800, 4611686018427387904)) f(fold, o, e)) where role is not null group by all", GAMES))
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    return M.folds(D.games(spark, d), ORIGINS).groupBy("sport", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query()
def elo_walk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.ratings(D.games(spark, d), SETTINGS))


@query()
def elo_final(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.final_ratings(D.games(spark, d), SETTINGS))


@query()
def elo_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every point of each sport's grid, over all its games; scored on one season."""
    grids = {s: [E.Setting(k, h, c) for k in ks for h in homes for c in carries] for s, (ks, homes, carries) in RATING_GRIDS.items()}
    return rounded(E.grid_search(D.games(spark, d), grids, "2000"))


@query()
def elo_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The ten best points of each grid and the worst."""
    return E.leaders(elo_grid(spark, d))


@query(with_sql("select sport, game_id from games where false", GAMES))
def elo_causality(spark: SparkSession, d: str) -> DataFrame:
    """No row: no forecast changes if later games are taken away."""
    return E.causality(D.games(spark, d), SETTINGS, 904608000).select("sport", "game_id")


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    own = resample.bootstrap_scalars(look(spark, d), by=["sport"])
    return rounded(resample.intervals(own, ["ece", "brier", "slope", "intercept"], by=["sport"]))


@query()
def bootstrap_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.bootstrap_curve(look(spark, d), [0.2, 0.4, 0.6, 0.8]))


@query()
def null_simulation(spark: SparkSession, d: str) -> DataFrame:
    found = resample.simulate_null(look(spark, d), 1226)
    return rounded(resample.intervals(found, ["ece", "max_bin_dev", "slope", "intercept"]))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    frame = R.assign_strata(R.analysis_frame(D.priced(spark, d), D.games(spark, d), D.patch(spark, d)))
    return frame.where("liquidity is not null").select("sport", "season", "game_id", "et_date", "liquidity", F.col("p_close").alias("p"), "y")


@query()
def slope_difference(spark: SparkSession, d: str) -> DataFrame:
    """Of the sport that the primary test is about."""
    rows = _levels(spark, d).where("sport = 'nba'")
    slopes = {r.liquidity: r.slope for r in X.cox_by(rows, ["liquidity"]).collect()}
    found = resample.slope_difference(rows.where("liquidity = 'low'"), rows.where("liquidity = 'high'"))
    return rounded(resample.intervals(found, ["difference"]).crossJoin(resample.achieved_level(found, slopes["low"] - slopes["high"])))


@query()
def cluster_slope_difference(spark: SparkSession, d: str) -> DataFrame:
    found = resample.cluster_slope_difference(_levels(spark, d).where("sport = 'nba'"), "liquidity", "et_date", "low", "high")
    return rounded(resample.intervals(found, ["difference"]))


@query()
def stationary_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = look(spark, d).select("et_date", F.pow(F.col("p") - F.col("y"), 2).alias("loss"))
    return rounded(resample.intervals(resample.stationary_mean(rows, "loss", "et_date"), ["mean"]))


@query()
def shuffled_agreement(spark: SparkSession, d: str) -> DataFrame:
    games = D.games(spark, d).select("sport", "season", "game_id", "winner")
    favourite = F.when(F.col("p") > 0.5, "home").otherwise("away").alias("market")
    rows = look(spark, d).select("sport", "season", "game_id", favourite).join(games, ["sport", "season", "game_id"])
    return rounded(resample.shuffled_agreement(rows, "market", "winner"))


@query()
def caliper_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.caliper_match(_levels(spark, d), ["sport"], "liquidity", "low", "high", "game_id", order=["season"]))


@query()
def rolling_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = features_of(spark, d).select("sport", "season", "game_id", F.coalesce("rest_days_diff", F.lit(0)).cast("double").alias("rest"), F.col("games_7d_diff").cast("double").alias("density"))
    priced = look(spark, d).select("sport", "season", "game_id", "p", "y")
    starts = D.games(spark, d).select("sport", "season", "game_id", "start_t")
    key = ["sport", "season", "game_id"]
    return rounded(M.rolling_nested(rows.join(priced, key).join(starts, key), ORIGINS, ["rest", "density"]))


@query()
def gbm_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold forecasts of each sport, by the folds of ``rolling_folds``."""
    key = ["sport", "season", "game_id"]
    rows = features_of(spark, d).join(look(spark, d).select(*key, "p", "y"), key).join(D.games(spark, d).select(*key, "start_t"), key)
    features = ["logit", "home_games_7d", "away_games_7d"]
    rows = kept(rows.withColumn("logit", F.ln(F.col("p") / (1 - F.col("p")))).select(*key, "y", "start_t", *features), "ceiling")  # trees read them again and again
    return rounded(each_sport(lambda s: M.rolling_ceiling(rows.where(F.col("sport") == s), ORIGINS, features)), 4)


#: Covariates of the hierarchical model by sport, and what is filled with medians before they are derived.
COVARIATES = {"nba": ["rest_diff", "b2b_diff", "travel_diff", "tz_diff"], "nhl": ["rest_diff", "home_b2b", "away_b2b", "travel_diff", "tz_diff"]}
FILLED = [f"{side}_{c}" for c in ("rest_days", "travel_km", "tz_shift") for side in ("away", "home")]


#: Rows whose medians, means and deviations a design of all seasons takes.
DEV = "season < '1998'"


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    """All games of both sports with features and the difference of ratings before them."""
    key = ["sport", "season", "game_id"]
    ratings = E.ratings(D.games(spark, d), SETTINGS).select(*key, (F.col("r_home") - F.col("r_away")).alias("rating_diff"), "y", "start_t")
    return features_of(spark, d).join(ratings, key)


def model_design(spark: SparkSession, d: str) -> DataFrame:
    """All games of each sport to train on; gaps are filled and covariates standardised by the development rows alone."""
    rows, parts = kept(_model_rows(spark, d), "rows"), []  # read again and again, after a walk
    for g, sport in enumerate(sorted(COVARIATES)):
        own = rows.where(F.col("sport") == sport)
        b2b = {f"{s}_b2b": F.coalesce(f"{s}_b2b", F.lit(False)).cast("double") for s in ("home", "away")}
        terms = M.derive_terms(M.fill(own, M.medians(own, FILLED, DEV)).withColumns(b2b))
        scaled = M.standardise(terms, M.scaler(terms, [*COVARIATES[sport], "rating_diff"], DEV))
        name = lambda side: F.concat_ws(":", "season", side).alias(side)
        parts.append(scaled.select(F.lit(g).alias("g"), F.lit("train").alias("role"), "sport", "season", "game_id", name("home"), name("away"), F.coalesce(F.col("neutral").cast("double"), F.lit(0.0)).alias("neutral"), F.col("y").cast("double").alias("y"), F.col("z_rating_diff").alias("rating"), F.array(*(F.col(f"z_{c}") for c in COVARIATES[sport])).alias("x")))
    return functools.reduce(DataFrame.unionByName, parts)


@query()
def hierarchical_chains(spark: SparkSession, d: str) -> DataFrame:
    """R-hat of each parameter of the fit of each sport over all its seasons; an unsound fit is refused."""
    fits = H.fit(model_design(spark, d), seed=1)
    found = H.diagnostics(spark, fits).persist()
    H.assert_sound(found)
    sport = F.element_at(F.array(*map(F.lit, sorted(COVARIATES))), F.col("g") + 1)
    return found.select(sport.alias("sport"), "parameter", F.round("rhat", 3).alias("rhat"), "divergences", "chains")


@query()
def rolling_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each sport's forecasts, fold by fold out of sample, with fits, medians and scales of what had started before."""
    design = H.rolling_design(kept(_model_rows(spark, d), "rows"), ORIGINS, FILLED, COVARIATES)
    return rounded(H.pooled(H.rolling_forecasts(design, seed=1)))


@query()
def gate(spark: SparkSession, d: str) -> DataFrame:
    """Results of the checks of a census. The given quotes are no series of the given games, so the check of series is left to the tests.

    Outcomes of the given priced games stand for the market's winners.
    """
    from plumbline.operators import gate as G

    games = D.games(spark, d)
    winners = games.select("sport", "season", "game_id", F.col("winner").alias("market_winner"))
    priced = kept(D.priced(spark, d).join(winners, ["sport", "season", "game_id"]), "priced")  # each check reads them
    results = G.run_gate(G.Census(games, priced, kept(D.misses(spark, d), "misses"), D.quotes(spark, d)), [c for c in G.CHECKS if c is not G.price_series])
    return spark.createDataFrame([(r.name, r.passed) for r in results], "name string, passed boolean")


@query()
def risk_tier_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = modelled(spark, d).select("y", F.round("m", 9).alias("m"), F.round("p", 9).alias("p"))
    return rounded(C.risk_tier_intervals(rows, "m", "p"))


@query()
def reliability_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.reliability_intervals(look(spark, d), BUCKET_EDGES))


@query()
def clark_west_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(each_sport(lambda s: C.clark_west_test(modelled(spark, d).where(F.col("sport") == s), "p", "m", "et_date")))


@query()
def stream_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The given events as a stream of raw polls, taken in to the end, and the table that stands then."""
    import uuid

    from plumbline.streaming.collector import current, start_collector

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parq*")
    polls = raw.select(
        F.lit("nba").alias("sport"), F.lit("2024").alias("season"), F.col("user_id").cast("string").alias("game_id"), F.col("event_type").alias("token"), F.lit("home").alias("side"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("captured_at"), F.col("value").cast("string").alias("midpoint"), F.lit(None).cast("string").alias("book"),
        F.lit(None).cast("timestamp").alias("start_time_utc"), F.col("event_id").cast("string").alias("run_id"),
    )
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/quotes-{uuid.uuid4().hex}"
    stream = start_collector(polls, f"{folder}/table", f"{folder}/checkpoint")
    stream.awaitTermination()
    return rounded(current(spark.read.parquet(f"{folder}/table")).select("dedup_key", "game_id", "token", "captured_at", "midpoint", "run_id"))




def _frame(spark: SparkSession, d: str) -> DataFrame:
    return R.analysis_frame(D.priced(spark, d), D.games(spark, d), D.patch(spark, d))


@query()
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.in_bands(Y.calibration_report(look(spark, d), ["sport"])))


@query()
def cell_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.cell_stats(_frame(spark, d)))


@query()
def primary_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.primary_test(_frame(spark, d)))


@query()
def range_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.range_sensitivity(_frame(spark, d)))


@query()
def look_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.sensitivity(_frame(spark, d)))


@query()
def sensitivity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Y.sensitivity_intervals(_frame(spark, d)))


@query()
def null_bands(spark: SparkSession, d: str) -> DataFrame:
    """The bands of every pool and size that an analysis runs at."""
    return rounded(Y.null_bands(look(spark, d)))


@query(with_sql("select g.sport, g.season, g.game_id, count(*) filter (where q.t <= s.tip_t) as n_pre_tipoff, max(q.t) filter (where q.t <= s.tip_t) as t_close, arg_max(q.p, q.t) filter (where q.t <= s.tip_t) as p_close from ticks q join starts s using (sport, season, game_id) join starts g using (sport, season, game_id) where q.side = 'click' group by all", D.QUOTES, D.STARTS, "ticks as (select sport, season, game_id, side, t, max(p) as p from quotes group by all)"))
def closing_prices(spark: SparkSession, d: str) -> DataFrame:
    ticks = D.quotes(spark, d).groupBy("sport", "season", "game_id", "side", "t").agg(F.max("p").alias("p"))
    sides = ticks.withColumn("side", F.when(F.col("side") == "click", "home").when(F.col("side") == "view", "away").otherwise(F.col("side")))
    return I.closing(sides, D.starts(spark, d)).select("sport", "season", "game_id", "n_pre_tipoff", "t_close", "p_close")


@query(with_sql("select reason, count(*) as n from misses where reason in ('no_market') group by reason", GAMES, D.MISSES))
def reprobe(spark: SparkSession, d: str) -> DataFrame:
    return I.to_reprobe(D.misses(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CUT = "select sport, season, game_id, case when game_id % 4 <> 0 then 'league' else 'market' end as cutoff_source, start_t as league_start_time, start_t + game_id % 7 * 600 as game_start_time from games"


@query(with_sql(f"select sport, season, game_id, case when cutoff_source = 'league' then league_start_time else game_start_time end as cutoff from ({_CUT})", GAMES))
def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("game_id")
    rows = D.games(spark, d).select("sport", "season", "game_id", F.when(k % 4 != 0, "league").otherwise("market").alias("cutoff_source"), F.col("start_t").alias("league_start_time"), (F.col("start_t") + k % 7 * 600).alias("game_start_time"))
    return rows.select("sport", "season", "game_id", T.cutoff().alias("cutoff"))


_PIVOT = ", ".join(f"max(p) filter (where horizon = '{h}') as p_{h}" for h in ("close", "t1h", "t6h", "t24h"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators import anchors as A

    return A.anchors_long(A.anchors_wide(D.quotes(spark, d), D.starts(spark, d)))


@query(f"select sport, season, game_id, {_PIVOT} from ({ORACLES['anchors_long']}) where side = 'click' group by all")
def horizon_prices(spark: SparkSession, d: str) -> DataFrame:
    return T.horizon_pivot(_anchors(spark, d), ["close", "t1h", "t6h", "t24h"], "click")


@query(with_sql("select p.sport, p.season, p.game_id, p_census, p_anchor from told p left join closes c using (sport, season, game_id) where p_census is distinct from p_anchor", f"closes as (select sport, season, game_id, max(p) filter (where horizon = 'close') as p_anchor from ({ORACLES['anchors_long']}) where side = 'click' group by all)", "told as (select sport, season, game_id, case when game_id % 9 = 0 then 0.5 else p_anchor end as p_census from closes)"))
def anchor_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """A ninth of the closes is changed, and must be found."""
    anchors = _anchors(spark, d)
    told = T.horizon_pivot(anchors, ["close"], "click").select("sport", "season", "game_id", F.when(F.col("game_id") % 9 == 0, 0.5).otherwise(F.col("p_close")).alias("p_home_close"))
    return T.close_disagreements(told, anchors, side="click")


@query(with_sql("select g.sport, g.season, count(*) as scheduled, count(p.game_id) as priced, count(m.game_id) as missed, count(p.game_id) + count(m.game_id) as attempted, case when count(p.game_id) + count(m.game_id) > 0 then round(count(p.game_id) / (count(p.game_id) + count(m.game_id)), 4) end as coverage from games g left join priced p using (sport, season, game_id) left join misses m using (sport, season, game_id) group by all", GAMES, D.PRICED, D.MISSES))
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return T.coverage_report(D.games(spark, d), D.priced(spark, d), D.misses(spark, d))


@query(with_sql("select sport, season, what, value, count(*) as n from (select sport, season, 'stale_flat_run' as what, coalesce(cast(stale_flat_run as varchar), 'unrecorded') as value from priced union all select sport, season, 'p_t6h', case when p_t6h is null then 'absent' else 'told' end from priced) group by all", GAMES, D.PRICED))
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = D.priced(spark, d).withColumn("p_t6h", F.when(F.col("p_t6h").isNotNull(), "told"))
    return T.value_counts(rows, {"stale_flat_run": "unrecorded", "p_t6h": "absent"})


@query(with_sql("select sport, season, count(*) as games, round(100.0 * avg(case when away_b2b then 1.0 else 0.0 end), 1) as away_b2b, round(100.0 * avg(case when home_b2b then 1.0 else 0.0 end), 1) as home_b2b, round(median(away_travel_km)) as median_travel_km, count(*) filter (where not away_travel_known and not away_first_of_season) + count(*) filter (where not home_travel_known and not home_first_of_season) as no_venue, count(*) filter (where away_first_of_season) + count(*) filter (where home_first_of_season) as first_games from (" + _features_sql() + ") group by sport, season", GAMES))
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.feature_summary(features_of(spark, d))


@query(with_sql("select distinct sport, season from games", GAMES))
def sport_seasons(spark: SparkSession, d: str) -> DataFrame:
    return T.sport_seasons(D.games(spark, d))


@query("select sport, season, week_of_season, priced, scheduled from (select *, row_number() over (partition by sport, season order by priced / scheduled, week_of_season) as k from (" + ORACLES["coverage_by_week"] + ")) where k = 1")
def worst_week(spark: SparkSession, d: str) -> DataFrame:
    return T.worst_week(R.coverage_by_week(D.games(spark, d), D.priced(spark, d), D.misses(spark, d)))


@query(with_sql("select sport, season, game_id, abs(date_diff('day', (select et_date from (select et_date, row_number() over (order by et_date, game_id) - 1 as i, count(*) over () as n from games) where i = n // 2), et_date)) as distance from games", GAMES))
def probe_order(spark: SparkSession, d: str) -> DataFrame:
    return T.probe_order(D.games(spark, d)).select("sport", "season", "game_id", F.col("distance").cast("long").alias("distance"))


@query(with_sql("select sport, season, count(*) as n, count(*) filter (where neutral_site) as neutral from games group by all", GAMES))
def burn_in_union(spark: SparkSession, d: str) -> DataFrame:
    """The seasons before 1998 stand for the burn-in."""
    games = D.games(spark, d)
    both = T.with_burn_in(games.where("season >= '1998'"), games.where("season < '1998'"))
    return both.groupBy("sport", "season").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("neutral_site"), 1)).alias("neutral"))


@query()
def fit_design(spark: SparkSession, d: str) -> DataFrame:
    games = D.games(spark, d)
    rows = T.design(features_of(spark, d), E.ratings(games, SETTINGS), games)
    return rounded(rows.select("sport", "season", "game_id", "rest_days_diff", "rating_diff", "y"))


@query()
def split_prize(spark: SparkSession, d: str) -> DataFrame:
    rows = R.assign_strata(kept(_frame(spark, d), "frame")).select("sport", "season", "game_id", "et_date", "liquidity", F.col("p_t1h").alias("p"), "y")
    rows = kept(rows, "split")  # for each sport
    return rounded(each_sport(lambda s: T.split_prize(rows.where(F.col("sport") == s), ["season", "game_id"], "et_date")))
