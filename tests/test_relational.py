"""As-of joins, anchors, books, frames and features on small inputs, odd ones included."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import anchors as A
from plumbline.operators import features as P
from plumbline.operators import frame as R
from plumbline.operators import outcomes as O
from plumbline.operators import series as Q
from plumbline.operators.asof import asof_join, range_history

T0, DAY = 1735689600, 86400
GAME = "sport string, season string, game_id string, et_date date, away string, home string, winner string, neutral_site boolean, start_t long"


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 8))), max_size=8), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 8), st.one_of(st.none(), st.integers(0, 9))), max_size=8), st.booleans(), st.sampled_from([None, 2]))
@settings(max_examples=12, deadline=None)
def test_asof_against_brute_force(spark, probes, builds, strict, tolerance):
    builds = [(*b, i) for i, b in enumerate(builds)]
    p = spark.createDataFrame([(*x, i) for i, x in enumerate(probes)], "k int, t long, n int")
    b = spark.createDataFrame(builds, "k int, s long, v int, tie int")
    got = {r.n: (r.v, r.tie) for r in asof_join(p, b, ["k"], "t", "s", strict=strict, take=["v", "tie"], tolerance=tolerance, tie=["tie"]).collect()}
    assert len(got) == len(probes)
    for n, (k, t) in enumerate(probes):
        fit = [x for x in builds if t is not None and x[0] == k and (x[1] < t if strict else x[1] <= t)]
        best = max(fit, key=lambda x: (x[1], x[3]), default=None)
        if best and tolerance is not None and t - best[1] > tolerance:
            best = None
        assert got[n] == ((best[2], best[3]) if best else (None, None))


def test_history_against_brute_force(spark):
    probes = [(k, t, n) for n, (k, t) in enumerate([(1, 5), (1, 1), (1, None), (2, 9), (3, 4), (None, 7), (1, 5)])]
    builds = [(k, t, n) for n, (k, t) in enumerate([(1, 1), (1, 4), (1, 5), (1, 4), (1, None), (2, 10), (2, 8), (None, 1)])]
    p, b = spark.createDataFrame(probes, "k int, t long, n int"), spark.createDataFrame(builds, "k int, s long, n int")
    got = sorted((r.n, -1 if r["__b_n"] is None else r["__b_n"]) for r in range_history(p, b, ["k"], "t", "s").collect())
    want = []
    for k, t, n in probes:
        want += [(n, i) for own, s, i in builds if None not in (k, t, s) and own == k and s < t] or [(n, -1)]
    assert got == sorted(want)


def test_earlier_games_are_counted_for_all_games(spark):
    from plumbline.plans import domain as D
    from plumbline.plans.queries import QUERIES

    assert "earlier_games" not in QUERIES
    games = D.games(spark, "/root/testdata/sf0.001")
    rows = P.by_team(P.neutral(games, None), "start_t").select("sport", "season", "game_id", "team", "start_t")
    found = range_history(rows, rows, ["sport", "season", "team"], "start_t", "start_t").groupBy("game_id", "team").agg(F.count("__b_game_id").alias("n"))
    want = sorted((r.game_id, r.team, r.n) for r in found.collect())
    got = sorted((r.game_id, r.team, r.prior_games) for r in QUERIES["rolling_counts"](spark, "/root/testdata/sf0.001").collect())
    assert got == want and len(got) == 2 * games.count()


def quotes(spark, rows):
    return spark.createDataFrame([("nba", "24", "g", "home", t, p) for t, p in rows], "sport string, season string, game_id string, side string, t long, p double")


def test_anchors_at_their_horizons(spark):
    starts = spark.createDataFrame([("nba", "24", "g", T0)], "sport string, season string, game_id string, tip_t long")
    rows = [(T0 + 1, 0.9), (T0, 0.5), (T0 - 3600, 0.4), (T0 - 3599, 0.45), (T0 - 21600, None), (T0 - 21601, 0.3)]
    wide = A.anchors_wide(quotes(spark, rows), starts).first()
    assert (wide.p_close, wide.p_t1h, wide.p_t6h, wide.p_t24h, wide.n_pre_tipoff) == (0.5, 0.4, 0.3, None, 4)
    long = {r.horizon: r.secs_before_tip for r in A.anchors_long(A.anchors_wide(quotes(spark, rows), starts)).collect()}
    assert long == {"close": 0, "t1h": 3600, "t6h": 21601}
    asked = spark.createDataFrame([("nba", "24", "g", "home", t) for t in (T0 - 3600, T0 - 30000)], "sport string, season string, game_id string, side string, as_of long")
    assert {r.as_of: r.p for r in A.price_as_of(A.anchors_long(A.anchors_wide(quotes(spark, rows), starts)), asked).collect()} == {T0 - 3600: 0.4, T0 - 30000: None}
    assert A.anchors_wide(quotes(spark, []), starts).count() == 0


def test_series(spark):
    flat = quotes(spark, [(i, 0.5) for i in range(10)])
    assert Q.stale_flat_run(flat, A.KEYS).first().stale_flat_run
    assert not Q.stale_flat_run(quotes(spark, [(i, 0.5) for i in range(9)]), A.KEYS).first().stale_flat_run
    assert Q.price_changes(quotes(spark, [(0, 0.1), (1, 0.1), (2, 0.3)]), A.KEYS).first().changes == 1
    zipped = spark.createDataFrame([("a", [1, 2, 3], [0.1, 0.2])], "k string, t array<long>, p array<double>")
    assert [tuple(r) for r in Q.insert_series(zipped).collect()] == [("a", 1, 0.1), ("a", 2, 0.2), ("a", 3, None)]


def books(spark):
    games = spark.createDataFrame([("nba", "24", f"g{i}", day(i), "a", "b", "home", False, T0 + i * DAY) for i in range(6)], GAME)
    priced = games.where("game_id < 'g4'").select("sport", "season", "game_id", F.lit(5.0).alias("volume"), F.lit(0.6).alias("p_close"))
    misses = games.where("game_id >= 'g4'").select("sport", "season", "game_id", F.lit("no_market").alias("reason"))
    return games, priced, misses


def test_books_balance_or_raise(spark):
    games, priced, misses = books(spark)
    O.assert_reconciled(games, priced, misses)
    with pytest.raises(O.BooksError, match="scheduled"):
        O.assert_reconciled(games, priced, misses.limit(1))
    O.assert_reconciled(games, priced, misses.limit(1), complete=False)
    with pytest.raises(O.BooksError, match="1 games are priced and missed"):
        O.assert_reconciled(games, priced, misses.unionByName(priced.limit(1).select("sport", "season", "game_id", F.lit("no_market").alias("reason"))))
    with pytest.raises(O.BooksError, match="no game"):
        O.assert_reconciled(games.where("game_id <> 'g0'"), priced, misses)
    assert O.reconcile(games.limit(0), priced.limit(0), misses.limit(0)).count() == 0
    with pytest.raises(ValueError):
        O.one_of(games, "sport", [])


def test_digest_ignores_order_but_not_content(spark):
    games, *_ = books(spark)
    a = O.content_digest(games).first()
    assert O.content_digest(games.orderBy(F.desc("game_id")).repartition(3)).first() == a
    assert O.content_digest(games.unionByName(games.limit(1))).first() != a
    assert O.content_digest(games.withColumn("home", F.when(F.col("game_id") == "g1", "x").otherwise(F.col("home")))).first() != a


def test_slices(spark):
    games, *_ = books(spark)
    ids = lambda df: sorted(r.game_id for r in df.collect())
    assert ids(O.slice_games(games, 2)) == ["g0", "g1"]
    assert ids(O.slice_games(games, 4, "stride")) == ["g0", "g1", "g3", "g4"]
    assert len(ids(O.slice_games(games, 99, "stride"))) == 6


def test_frame_keeps_null_volume_null(spark):
    games, priced, _ = books(spark)
    priced = priced.withColumn("volume", F.when(F.col("game_id") != "g1", F.col("volume")).cast("double"))
    patch = spark.createDataFrame([("nba", "24", "g1", 3.0, "again")], "sport string, season string, game_id string, volume_recovered double, volume_source string")
    bare = {r.game_id: (r.volume, r.volume_source) for r in R.analysis_frame(priced, games).collect()}
    assert bare["g1"] == (None, "absent") and bare["g0"] == (5.0, "market")
    assert {r.game_id: (r.volume, r.volume_source) for r in R.analysis_frame(priced, games, patch).collect()}["g1"] == (3.0, "again")
    split = R.median_split(R.analysis_frame(priced, games), "volume", ("sport",), "low", "high", "s")
    assert {r.game_id: r.s for r in split.collect()} == {"g0": "low", "g1": None, "g2": "low", "g3": "low"}


VENUES = [("nba", t, lat, lon, tz) for t, lat, lon, tz in (("bos", 42.366, -71.062, -5.0), ("nyk", 40.751, -73.994, -5.0), ("lal", 34.043, -118.267, -8.0))]


def league(spark, neutral=False):
    rows = [("nba", "24", "g1", day(0), "bos", "nyk", "home", neutral, T0), ("nba", "24", "g2", day(1), "nyk", "bos", "home", False, T0 + DAY), ("nba", "24", "g3", day(4), "bos", "lal", None, False, T0 + 4 * DAY)]
    return spark.createDataFrame(rows, GAME), spark.createDataFrame(VENUES, "sport string, team string, lat double, lon double, tz_offset_std double")


def test_features_of_a_game(spark):
    games, venues = league(spark)
    f = P.assemble(games, P.targets_at(games.where("game_id = 'g3'"), T0 + 4 * DAY), venues).first()
    assert (f.away_rest_days, f.away_b2b, f.home_rest_days, f.home_first_of_season, f.away_prior_games, f.away_prior_settled, f.away_win_rate, f.home_win_rate) == (3, False, None, True, 2, 2, 0.5, None)
    assert 4100 < f.away_travel_km < 4250 and f.away_tz_shift == -3.0 and f.home_travel_km is None and f.home_travel_known is False
    assert not any("price" in c or c.startswith("p_") for c in f.asDict())


def test_results_wait_for_their_delay(spark):
    games, venues = league(spark)
    slate = games.where("game_id = 'g3'")
    at = lambda t: P.assemble(games, P.targets_at(slate, t), venues).first()
    assert (at(T0 + DAY + 1).away_prior_games, at(T0 + DAY + 1).away_prior_settled) == (2, 1)
    assert at(T0 + DAY + 8399).away_prior_settled == 1 and at(T0 + DAY + 8400).away_prior_settled == 2
    assert at(T0 + DAY).away_prior_games == 1


def test_neutral_sites_have_no_travel(spark):
    games, venues = league(spark)
    sites = spark.createDataFrame([("nba", "24", "g2")], "sport string, season string, game_id string")
    f = P.assemble(games, P.targets_at(games.where("game_id = 'g3'"), T0 + 4 * DAY), venues, sites).first()
    assert f.away_travel_km is None and f.away_tz_shift is None and f.away_rest_days == 3


def test_leaks_are_refused(spark):
    games, venues = league(spark)
    with pytest.raises(P.LeakError):
        P.assemble(games, P.targets_at(games.where("game_id = 'g1'"), T0 + 1), venues)
    for wrong in (True, 1.0, "1", None, dt.datetime(2025, 1, 1)):
        with pytest.raises(TypeError):
            P.targets_at(games, wrong)
    assert P.canary(games, games.where("game_id = 'g3'"), venues, T0 + DAY + 10).count() == 0
    whole = P.assemble
    with pytest.MonkeyPatch.context() as patch:  # a leak: it counts games that are not played yet
        patch.setattr(P, "assemble", lambda g, *a, **kw: whole(g, *a, **kw).crossJoin(g.agg(F.count(F.lit(1)).alias("seen"))))
        assert P.canary(games, games.where("game_id = 'g3'"), venues, T0 + DAY + 10).count() == 2
    assert P.assemble(games.limit(0), P.targets_at(games.limit(0), T0), venues).count() == 0


def test_one_plan_for_backtest_and_slate(spark):
    games, venues = league(spark)
    back = P.assemble(games, P.backtest_targets(games, 0), venues).where("game_id = 'g3'").collect()
    live = P.assemble(games, P.targets_at(games.where("game_id = 'g3'"), T0 + 4 * DAY), venues).collect()
    assert back == live


def test_a_random_sample_is_the_same_however_it_is_dealt(spark):
    from plumbline.operators import elo as E
    from plumbline.operators.anchors import price_table
    from plumbline.operators.outcomes import random_games

    games = spark.createDataFrame([("nba", str(i % 3), f"g{i}") for i in range(300)] + [("nhl", "0", "only")], "sport string, season string, game_id string")
    one, other = (sorted(map(tuple, random_games(games.repartition(n), 7).collect())) for n in (1, 6))
    assert one == other and len(one) == 3 * 7 + 1
    assert one != sorted(map(tuple, random_games(games, 7, seed=24).collect()))
    assert "WindowGroupLimit" in random_games(games, 7)._jdf.queryExecution().executedPlan().toString()
    assert random_games(games.limit(0), 7).count() == 0
    anchors = spark.createDataFrame([("nba", "1", "g", "home", h) for h in (0, 3600, 60)], "sport string, season string, game_id string, side string, horizon_secs long")
    assert [r.horizon_secs for r in price_table(anchors).collect()] == [3600, 60, 0]
    scores = spark.createDataFrame([("nba", float(i), 50.0, 0.5, 0.6 + i / 100) for i in range(6)], "sport string, k double, home_bonus double, carry double, log_loss double")
    found = E.leaders(scores, 2).orderBy("place").collect()
    assert [(r.place, r.k) for r in found] == [(1, 0.0), (2, 1.0), (6, 5.0)] and found[0].spread == pytest.approx(0.05)


def test_settled_games_are_dealt_out_before_they_are_told_apart(spark):
    priced, misses = (spark.createDataFrame([("nba", "24", i % 50) for i in r], "sport string, season string, game_id long") for r in (range(0, 80), range(40, 60)))
    found = O.settled(priced, misses)
    assert found.rdd.getNumPartitions() == O.DEALT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.game_id for r in found.collect()) == list(range(50))
