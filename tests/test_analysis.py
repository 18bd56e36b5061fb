"""Composites: reports, sensitivity, resolving and classifying games, the step runner."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis as Y
from plumbline.operators import ingest as I
from plumbline.operators import reports as T
from plumbline.plans.runner import Step, run_steps

KEYS = "sport string, season string, game_id string"


def frame(spark, n=800, k=1.5):
    """Liquid games are priced well, the others too boldly."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x, volume = rng.normal(), float(rng.lognormal())
        y = float(rng.random() < 1 / (1 + np.exp(-x)))
        p = float(1 / (1 + np.exp(-(x * (k if volume <= 1 else 1.0)))))
        rows.append(("nba", "24", f"g{i:04}", dt.date(2025, 1, 1) + dt.timedelta(days=i // 6), i * 20 // n + 1, volume if i % 50 else None, p, p * 0.9 + 0.05, p, None, i % 9 == 0, y))
    return spark.createDataFrame(rows, f"{KEYS}, et_date date, week_of_season int, volume double, p_close double, p_t1h double, p_t6h double, p_t24h double, stale_flat_run boolean, y double")


def test_reports_and_sensitivity(spark):
    df = frame(spark).cache()
    report = Y.in_bands(Y.calibration_report(df.withColumn("p", F.col("p_close")), ["sport"])).first()
    assert report.n == 800 and report.slope < 1 and report.reliability >= 0
    cells = Y.cell_stats(df).collect()
    assert len(cells) == 4 and all(c.ref_n == 200 for c in cells)
    test = Y.primary_test(df, reps=30).collect()
    pooled = next(r for r in test if r.season is None)
    assert pooled.difference < 0 and pooled.slope_high > pooled.slope_low and pooled.game_hi < 0 and pooled.asl == 0 and pooled.wider in ("games", "dates")
    assert [(r.season, r.n_low) for r in test if r.season] == [("24", pooled.n_low)]
    assert next(r.difference for r in test if r.season) == pytest.approx(pooled.difference)
    samples = {(r["sample"], r.liquidity) for r in Y.range_sensitivity(df).collect()}
    assert ("matched", "low") in samples and ("0.20-0.80", "high") in samples
    looks = {r["sample"]: r.volume_absent for r in Y.sensitivity(df).collect()}
    assert set(looks) >= {"p_close", "fresh", "stale"} and set(looks.values()) == {16}
    each = {r["sample"]: r for r in Y.sensitivity_intervals(df, reps=20).collect()}
    assert set(each) == {"all", "0.20-0.80", "0.35-0.65", "matched", *Y.LOOKS, "fresh", "stale"} - {"p_t24h"}
    assert each["all"].difference == pytest.approx(each["p_close"].difference) == pytest.approx(pooled.difference)
    assert each["all"].game_lo < each["all"].difference < each["all"].game_hi and each["matched"].n_low == each["matched"].n_high
    bands = spark.createDataFrame([("ece", 0.0, 0.02, 0.031), ("max_bin_dev", 0.0, 0.09, 0.07), ("slope", 0.8, 1.0, 1.2), ("intercept", -0.07, 0.07, 1.0)], "name string, lo double, hi double, p99 double")
    assert {r.name: r.breach for r in Y.null_breaches(bands).collect()} == {"ece": True, "max_bin_dev": False, "slope": True, "intercept": False}


def test_games_are_resolved_and_classified(spark):
    day = dt.date(2025, 1, 1)
    games = spark.createDataFrame([("nba", "24", f"g{i}", day + dt.timedelta(days=10 * i), "BOS", "NYK", "home") for i in range(5)], f"{KEYS}, et_date date, away string, home string, winner string")
    teams = spark.createDataFrame([("nba", "BOS", ["Celtics"], ["bos"]), ("nba", "NYK", ["Knicks"], ["nyk", "ny"])], "sport string, team string, labels array<string>, priors array<string>")
    candidates = I.slug_candidates(games, teams)
    first = candidates.where("game_id = 'g0' and place = 1").first().slug
    assert first == "nba-bos-nyk-2025-01-01" and candidates.where("game_id = 'g0' and slug = 'nba-bos-ny-2025-01-02'").count() == 1
    market = lambda kind, a="Celtics", h="Knicks": (kind, a, h, "t")
    events = [("nba-bos-nyk-2025-01-01", [market("spreads"), market("moneyline")]), ("nba-bos-ny-2025-01-11", [market(None)]), ("nba-bos-nyk-2025-01-21", [market("spreads")]), ("nba-bos-nyk-2025-01-31", [market("moneyline", "Bulls", "Heat")])]
    confirmed = I.confirm(candidates, spark.createDataFrame(events, "slug string, markets array<struct<type:string,away_label:string,home_label:string,token:string>>"))
    got = {r.game_id: (r.slug, r.saw_events, r.partial_only) for r in confirmed.collect()}
    assert got == {"g0": ("nba-bos-nyk-2025-01-01", True, False), "g1": ("nba-bos-ny-2025-01-11", True, False), "g2": (None, True, True), "g3": (None, True, False), "g4": (None, False, False)}
    assert {(r.team, r.learned) for r in I.learned_priors(confirmed, games).collect()} == {("BOS", "bos")}
    again = I.resolve(games, teams, spark.createDataFrame(events, "slug string, markets array<struct<type:string,away_label:string,home_label:string,token:string>>"))
    assert {r.game_id: r.slug for r in again.collect()} == {g: x[0] for g, x in got.items()}
    tip = 1_700_000_000
    quotes = spark.createDataFrame([("nba", "24", g, s, tip - 60 * i, 0.6 if s == "home" else 0.4) for g in ("g0",) for s in ("home", "away") for i in range(12)], f"{KEYS}, side string, t long, p double")
    starts = games.select("sport", "season", "game_id", F.lit(tip).cast("long").alias("tip_t"))
    closes = I.closing(quotes, starts)
    row = closes.first()
    assert row.p_close == 0.6 and row.complement_ok is True and row.stale_flat_run is True and row.pairs == 12 and row.secs_before_tip == 0
    settled = spark.createDataFrame([("nba", "24", "g0", 1.0, 0.0)], f"{KEYS}, home_settled double, away_settled double")
    reasons = {r.game_id: r.reason for r in I.classify(confirmed, closes, settled, games).collect()}
    assert reasons == {"g0": None, "g1": "no_pre_tipoff_points", "g2": "no_moneyline_market", "g3": "label_mismatch_at_slug", "g4": "no_market"}
    day_of = lambda g, hour: (*g, dt.datetime(2025, 1, 1, hour, tzinfo=dt.UTC) + dt.timedelta(days=10 * int(g[2][1])))
    begins = spark.createDataFrame([day_of(("nba", "24", "g0"), 9), day_of(("nba", "24", "g1"), 20)], f"{KEYS}, market_start timestamp")
    checked = {r.game_id: r.reason for r in I.classify(confirmed, closes, settled, games, begins).collect()}
    assert checked["g0"] not in (None, reasons["g1"]) and "tart" in checked["g0"] and checked["g1"] == reasons["g1"] and checked["g4"] == "no_market"
    with pytest.raises(ValueError):
        I.to_reprobe(games, [])


def test_a_rematch_blocks_the_next_day(spark):
    day = dt.date(2025, 1, 1)
    games = spark.createDataFrame([("nba", "24", f"g{i}", day + dt.timedelta(days=i), "A", "B") for i in range(2)], f"{KEYS}, et_date date, away string, home string")
    teams = spark.createDataFrame([("nba", t, [t], [t.lower()]) for t in "AB"], "sport string, team string, labels array<string>, priors array<string>")
    slugs = {(r.game_id, r.slug) for r in I.slug_candidates(games, teams).collect()}
    assert slugs == {("g0", "nba-a-b-2025-01-01"), ("g1", "nba-a-b-2025-01-02"), ("g1", "nba-a-b-2025-01-03")}


def test_forecast_log_and_slate(spark):
    log = spark.createDataFrame([("g", 1, False, 0.1), ("g", 2, True, 0.2), ("g", 3, True, 0.3)], "game_id string, logged_at int, blind boolean, p_home double")
    assert [r.p_home for r in I.first_blind(log).collect()] == [0.2]
    finals = spark.createDataFrame([("nba", "a", 1600.0)], "sport string, team string, rating double")
    slate = spark.createDataFrame([("nba", "a", "b", True), ("nba", "b", "a", False)], "sport string, away string, home string, neutral_site boolean")
    got = {r.home: (round(r.p_home, 4), r.lean) for r in I.slate_forecast(finals, slate, 50.0).collect()}
    assert got == {"b": (0.3599, "away"), "a": (0.7034, "home")}


def test_steps():
    seen = []
    steps = [Step("a", lambda: seen.append("a"), lambda: True), Step("b", lambda: seen.append("b")), Step("c", lambda: 1 / 0)]
    quiet = lambda _: None
    assert run_steps(steps, dry=True, log=quiet) == ["a", "b", "c"] and seen == []
    assert run_steps(steps[:2], skip_done=True, log=quiet) == ["b"]
    assert run_steps(steps[:2], start="b", log=quiet) == ["b"] and seen == ["b", "b"]
    with pytest.raises(RuntimeError, match="c failed"):
        run_steps(steps, start="c", log=quiet)
    with pytest.raises(ValueError):
        run_steps(steps, start="z", log=quiet)


def test_reports_of_a_census(spark, tmp_path):
    games = spark.createDataFrame([("nba", "24", f"g{i}", dt.date(2025, 1, 1) + dt.timedelta(days=i), "a", "b", 1, 2, "home", None if i else True, 100 + i) for i in range(4)], f"{KEYS}, et_date date, away string, home string, away_pts int, home_pts int, winner string, neutral_site boolean, start_t long")
    assert [(r.game_id, r.distance) for r in T.probe_order(games).collect()] == [("g2", 0), ("g1", 1), ("g3", 1), ("g0", 2)]
    sites = games.where("game_id in ('g0', 'g3')").select("sport", "season", "game_id")
    assert [tuple(r) for r in T.overridden(games, sites).collect()] == [("nba", 1)]
    both = T.with_burn_in(games, games)
    assert both.count() == 8 and both.where("neutral_site is null").count() == 0
    anchors = spark.createDataFrame([("nba", "24", "g0", "home", "close", 0.5), ("nba", "24", "g1", "home", "t1h", 0.4), ("nba", "24", "g2", "away", "close", 0.3)], f"{KEYS}, side string, horizon string, p double")
    priced = spark.createDataFrame([("nba", "24", "g0", 0.5), ("nba", "24", "g1", 0.4), ("nba", "24", "g2", None)], f"{KEYS}, p_home_close double")
    assert [(r.game_id, r.p_census, r.p_anchor) for r in T.close_disagreements(priced, anchors).collect()] == [("g1", 0.4, None)]
    weeks = spark.createDataFrame([("nba", "24", 1, 0, 0), ("nba", "24", 2, 1, 2), ("nba", "24", 3, 2, 4)], "sport string, season string, week_of_season int, priced int, scheduled int")
    assert [tuple(r) for r in T.worst_week(weeks).collect()] == [("nba", "24", 2, 1, 2)]
    none = T.coverage_report(games, priced.limit(0), priced.limit(0)).first()
    assert (none.scheduled, none.attempted, none.coverage) == (4, 0, None)
    T.write_sorted(games, f"file://{tmp_path}/games", ["game_id"])
    assert len(list((tmp_path / "games").glob("*.parquet"))) == 1


def test_a_prize_is_won_where_prices_are_too_bold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        x = rng.normal()
        rows.append((i, str(i // 8), "low" if i % 2 else "high", float(1 / (1 + np.exp(-2.5 * x))), float(rng.random() < 1 / (1 + np.exp(-x)))))
    df = spark.createDataFrame(rows, "game_id int, day string, liquidity string, p double, y double")
    cells = {(r.half_spread, r.fee): r for r in T.split_prize(df, ["game_id"], "day", [(0.0, 0.0), (0.02, 0.05), (0.9, 0.0)], reps=200).collect()}
    found, decided, dear = (cells[c] for c in ((0.0, 0.0), (0.02, 0.05), (0.9, 0.0)))
    assert 0 < found.bets <= 600 and found.lo < found.roi < found.hi and found.roi > 0 and found.dates <= 75
    assert decided.bets < found.bets and decided.roi < found.roi and [r.decides for r in (found, decided, dear)] == [False, True, False]
    assert (dear.bets, dear.roi, dear.dates, dear.lo) == (0, None, 0, None)
    assert T.split_prize(df, ["game_id"], "day", [(0.9, 0.0)], reps=5).first().bets == 0


def test_a_prize_by_hand(spark):
    df = spark.createDataFrame([(0.5, 0.6, 1), (0.5, 0.6, 0), (0.2, 0.9, 1), (0.5, 0.515, 1)], "p double, fair double, y int")
    found = {(r.half_spread, r.fee): r for r in Y.prize(df, "fair").collect()}
    assert set(found) == {(h, f) for h in (0.01, 0.02, 0.03) for f in (0.0, 0.05)}
    assert found[0.01, 0.0].bets == 4 and found[0.02, 0.0].bets == 3
    assert found[0.02, 0.0].profit == pytest.approx(1 / 0.52 - 1 - 1 + 1 / 0.22 - 1)
    paid = [0.5 + 0.02 + 0.05 * 0.25, 0.2 + 0.02 + 0.05 * 0.16]
    assert found[0.02, 0.05].roi == pytest.approx((1 / paid[0] - 1 - 1 + 1 / paid[1] - 1) / 3)


def test_reports_read_what_was_written_once(spark, monkeypatch):
    """What several passes read is joined once: rows to fill and the parts of a report."""
    from plumbline.operators import analysis
    from plumbline.plans import models

    real, met = models.kept, []

    def counted(df, name):
        met.append(name)
        return real(df, name)

    monkeypatch.setattr(models, "kept", counted)
    monkeypatch.setattr(analysis, "kept", counted)
    models.median_fill(spark, "/root/testdata/sf0.001")
    models.calibration_report(spark, "/root/testdata/sf0.001")
    assert met == ["features", "report"]
def test_a_prize_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(v: float) -> float:
        seen.add(1)
        return v

    rows = [(i, str(i // 8), "low" if i % 2 else "high", (i * 37 % 97 + 1) / 99, float(i * 53 % 89 < i * 37 % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "game_id int, day string, liquidity string, p double, y double")
    found = T.split_prize(df.withColumn("p", F.udf(touch, "double").asNondeterministic()("p")), ["game_id"], "day", [(0.0, 0.0)], reps=20).first()
    assert found.bets > 0 and 400 <= seen.value <= 800
