"""Analyses put together from the operators: calibration reports, stratified tests and their sensitivity, the value of an edge."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import settled_bet
from plumbline.operators import resample
from plumbline.operators.cox import cox_by
from plumbline.operators.frame import LOOKS, assign_strata, look
from plumbline.operators.matching import CALIPER, caliper_match
from plumbline.operators.scores import bin_count, bin_table, calibration_error, equal_count_bins, murphy, null_reference, pool_shape, score_set
from plumbline.schemas import COST_GRID, GATE_ECE, GATE_INTERCEPT, GATE_MAX_BIN, GATE_SLOPE, NULL_SIZES, PRICE_BANDS
from plumbline.sources.scratch import kept


def calibration_report(df: DataFrame, by: Sequence[str], key: Sequence[str] = ("game_id",)) -> DataFrame:
    """One row per group: n, scores, ECE with bins by the rule of 150, Murphy parts, slope and intercept (null without a fit)."""
    df = kept(df, "report")  # each part reads the rows again
    sized = df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), list(by)).withColumn("__k", bin_count(F.col("__n")))
    bins = bin_table(equal_count_bins(sized, F.col("__k"), by, key), by)
    parts = [score_set(df, by), calibration_error(bins, by).drop("n"), murphy(bins, by), cox_by(df, by).drop("n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by))
    return out


def in_bands(report: DataFrame) -> DataFrame:
    """Whether each figure of a report lies in the gate's band; no fit is outside."""
    inside = lambda c, band: F.coalesce(F.col(c).between(*band), F.lit(False))
    return report.withColumns({"ece_ok": F.col("ece") <= GATE_ECE, "max_bin_ok": F.col("max_bin_dev") <= GATE_MAX_BIN, "slope_ok": inside("slope", GATE_SLOPE), "intercept_ok": inside("intercept", GATE_INTERCEPT)})


def cell_stats(frame: DataFrame, look_name: str = "p_close") -> DataFrame:
    """The 2 x 2 cells of each sport and season with the null of their own size; empty cells have no row."""
    rows = look(assign_strata(frame), look_name).where("liquidity is not null")
    return null_reference(calibration_report(rows, ["sport", "season", "phase", "liquidity"]))


def _slopes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sizes and slopes of both strata, and the low one's slope less the high one's."""
    found = cox_by(rows, [*by, "liquidity"]).groupBy(*by).agg(*(F.max(F.when(F.col("liquidity") == k, F.col(c))).alias(f"{c}_{k}") for c in ("n", "slope") for k in ("low", "high")))
    return found.withColumn("difference", F.col("slope_low") - F.col("slope_high"))


def _differences(rows: DataFrame, by: str, reps: int, seed: int) -> DataFrame:
    """``_slopes`` of each group with the interval over games and the share of replicates of another sign; too few fits give no interval."""
    own = resample.slope_differences(rows, by, "liquidity", "low", "high", reps, seed)
    value = F.when(~F.isnan("difference"), F.col("difference"))
    enough = F.count(value) >= (1 - resample.FAILURES) * F.count(F.lit(1))
    drawn = own.groupBy(by).agg(*(F.when(enough, F.percentile(value, q)).alias(c) for c, q in (("game_lo", 0.025), ("game_hi", 0.975))), (F.count(F.when(value <= 0, 1)) / F.count(value)).alias("below"), (F.count(F.when(value >= 0, 1)) / F.count(value)).alias("above"), (1 / F.count(F.lit(1))).alias("asl_floor"))
    return _slopes(rows, [by]).join(drawn, by).withColumn("asl", F.when(F.col("difference") > 0, F.col("below")).otherwise(F.col("above"))).drop("below", "above")


def primary_test(frame: DataFrame, sport: str = "nba", look_name: str = "p_close", reps: int = 4000, seed: int = 0) -> DataFrame:
    """Slope of the less liquid games less that of the liquid ones, of all seasons (``season`` is null) and of each.

    Both slopes, their difference, its interval over games, the share of
    replicates of another sign, and of all seasons also the interval over dates
    and which of the two is wider. A season with too few fits has no interval.
    """
    rows = look(assign_strata(frame), look_name).where((F.col("sport") == sport) & F.col("liquidity").isNotNull())
    slopes = _slopes(rows).first()
    drawn = resample.slope_difference(rows.where("liquidity = 'low'"), rows.where("liquidity = 'high'"), reps, seed)
    games = resample.intervals(drawn, ["difference"]).select(F.col("lo").alias("game_lo"), F.col("hi").alias("game_hi"))
    dates = resample.intervals(resample.cluster_slope_difference(rows, "liquidity", "et_date", "low", "high", reps, seed), ["difference"]).select(F.col("lo").alias("date_lo"), F.col("hi").alias("date_hi"))
    wider = F.when(F.col("date_hi") - F.col("date_lo") > F.col("game_hi") - F.col("game_lo"), "dates").otherwise("games")
    level = resample.achieved_level(drawn, slopes["difference"] or 0.0)
    pooled = _slopes(rows).crossJoin(games).crossJoin(level).crossJoin(dates).withColumn("wider", wider).withColumn("season", F.lit(None).cast("string"))

    each = _differences(rows, "season", reps, seed)
    return pooled.unionByName(each, allowMissingColumns=True)


def _price_samples(rows: DataFrame, caliper: float) -> list[tuple[str, DataFrame]]:
    """All prices, those within bands, and games matched on price."""
    samples = [("all", rows)] + [(f"{lo:.2f}-{hi:.2f}", rows.where(F.col("p").between(lo, hi))) for lo, hi in PRICE_BANDS]
    pairs = caliper_match(rows, ["sport"], "liquidity", "low", "high", "game_id", caliper=caliper, order=["season"])
    ids = pairs.select(F.explode(F.array("low_key", "high_key")).alias("game_id"))
    return [*samples, ("matched", rows.join(ids, "game_id", "left_semi"))]


def _look_samples(own: DataFrame) -> list[tuple[str, DataFrame]]:
    """Every look, and the close of fresh and of stale prices."""
    return [(name, look(own, name)) for name in LOOKS] + [("fresh", look(own, "p_close").where(~F.col("stale_flat_run"))), ("stale", look(own, "p_close").where("stale_flat_run"))]


def sensitivity_intervals(frame: DataFrame, sport: str = "nba", caliper: float = CALIPER, reps: int = 2000, seed: int = 0) -> DataFrame:
    """The difference of slopes in each sample of ``range_sensitivity`` and ``sensitivity``, each with an interval of its own, never one over all."""
    own = kept(assign_strata(frame.where(F.col("sport") == sport)).where("liquidity is not null"), "strata")  # each sample reads them
    samples = _price_samples(look(own, "p_close"), caliper) + _look_samples(own)
    rows = functools.reduce(DataFrame.unionByName, (x.select(F.lit(name).alias("sample"), "liquidity", "p", "y") for name, x in samples))
    return _differences(rows, "sample", reps, seed)


def range_sensitivity(frame: DataFrame, sport: str = "nba", look_name: str = "p_close", caliper: float = CALIPER) -> DataFrame:
    """Slopes by liquidity over all prices, within bands, and over games matched on price; with the spread of the prices."""
    rows = kept(look(assign_strata(frame), look_name).where((F.col("sport") == sport) & F.col("liquidity").isNotNull()), "strata")  # each sample reads them
    out = None
    for name, own in _price_samples(rows, caliper):
        one = cox_by(own, ["liquidity"]).join(pool_shape(own, ["liquidity"]), "liquidity").withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sensitivity(frame: DataFrame, sport: str = "nba") -> DataFrame:
    """Slopes by liquidity at every look, and at the close for fresh and for stale prices; games without volume are counted."""
    own = assign_strata(frame.where(F.col("sport") == sport))
    absent = own.agg(F.count(F.when(F.col("volume").isNull(), 1)).alias("volume_absent"))
    out = None
    for name, rows in _look_samples(own):
        one = cox_by(rows.where("liquidity is not null"), ["liquidity"]).withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(absent)


def prize(df: DataFrame, fair: str, costs: Sequence[tuple[float, float]] = COST_GRID, p: str = "p", y: str = "y") -> DataFrame:
    """Bets of one unit each, profit and return of following a fair price, at each half spread and fee."""
    grid = df.sparkSession.createDataFrame([(float(h), float(f)) for h, f in costs], "half_spread double, fee double")
    bets = df.crossJoin(F.broadcast(grid)).withColumn("bet", settled_bet(p, fair, y, "half_spread", "fee")).where("bet is not null")
    return bets.groupBy("half_spread", "fee").agg(F.count(F.lit(1)).alias("bets"), F.sum("bet.profit").alias("profit"), F.avg("bet.profit").alias("roi"))


def null_bands(df: DataFrame, sizes: Sequence[tuple[str, int]] = NULL_SIZES, reps: int = 1500, seed: int = 7) -> DataFrame:
    """By pool, size and statistic what true prices give: the 2.5, 97.5 and 99 % points, and whether the gate would fire on them.

    ``breach`` is told of the whole census alone (pool ``all``), which the
    gate's bounds are for; other sizes go by their own rows and have null.
    """
    names = ["ece", "max_bin_dev", "slope", "intercept"]
    drawn = resample.simulate_nulls(df, sizes, reps=reps, seed=seed)
    bands = resample.intervals(drawn, names, by=["pool", "n"])
    tops = drawn.select("pool", "n", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))))
    p99 = tops.groupBy("pool", "n", "name").agg(F.percentile(F.when(~F.isnan("v"), F.col("v")), 0.99).alias("p99"))
    told = null_breaches(bands.join(p99, ["pool", "n", "name"]))
    return told.withColumn("breach", F.when(F.col("pool") == "all", F.col("breach")))


def null_breaches(bands: DataFrame) -> DataFrame:
    """Simulated null bands (name, lo, hi, p99) that reach out of the gate's: there the gate would fire on true prices.

    Errors, which are only bounded above, are held to their 99 % point; slope
    and intercept to both ends of the 95 % band.
    """
    allowed = {"ece": (0.0, GATE_ECE), "max_bin_dev": (0.0, GATE_MAX_BIN), "slope": GATE_SLOPE, "intercept": GATE_INTERCEPT}
    low = high = F.lit(None).cast("double")
    for name, (a, b) in allowed.items():
        low, high = F.when(F.col("name") == name, a).otherwise(low), F.when(F.col("name") == name, b).otherwise(high)
    error = F.col("name").isin("ece", "max_bin_dev")
    breach = F.when(error, F.col("p99") > high).otherwise((F.col("lo") < low) | (F.col("hi") > high))
    return bands.withColumns({"gate_lo": low, "gate_hi": high, "breach": breach})
