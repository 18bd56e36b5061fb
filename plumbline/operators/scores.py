"""Calibration: equal-count bins, proper scores and their parts, reliability curves, tiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import log_loss, logit, squared_error
from plumbline.operators.quantiles import quantiles, same
from plumbline.operators.resample import hit_rate, stationary_mean
from plumbline.schemas import BIN_MAXIMUM, BIN_MINIMUM, NULL_TABLE, RISK_TIERS


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank", total: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """Rank from 0 in a total order, of the table or of each group, and the number of rows, without one task that sees all rows.

    A bounded sample of the order's own columns gives the bounds of ranges, each
    of which is ranked by itself; the counts of the ranges before, one number
    for each group and range, are added. Bounds are whole tuples, so many equal
    prices are spread by the columns behind them.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(*order).dropna().orderBy(F.xxhash64(*order), *order).limit(50 * n).collect()
    seen = sorted(set(map(tuple, sample)))
    edges = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    bound = lambda e: F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(f"c{i}") for i, (c, v) in enumerate(zip(order, e, strict=True))))
    own = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(order)))
    place = F.size(F.filter(F.array(*map(bound, edges)), lambda e: e <= own)) if edges else F.lit(0)
    group = F.struct(*(F.col(c) for c in by), F.lit(0).alias("__all"))  # null is a group too
    held = df.withColumn("__part", place).withColumn("__group", group)
    ranked = held.withColumn("__own", F.row_number().over(Window.partitionBy("__group", "__part").orderBy(*order)) - 1)
    counts = held.groupBy("__group", "__part").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy("__group")
    before = counts.select(F.col("__group").alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias(total))
    joined = ranked.join(before if by else F.broadcast(before), F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))  # without groups a row per range
    return joined.withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__group", "__g", "__p")


def equal_count_bins(df: DataFrame, n_bins: int | Column, by: Sequence[str] = (), key: Sequence[str] = (), p: str = "p") -> DataFrame:
    """``bin`` from 0, of (nearly) equal counts in order of price, ties in order of ``key``.

    The edges are the integer parts of n * i / bins. Ranks come from
    ``global_rank``, so no task holds a whole group.
    """
    ranked = global_rank(df, [p, *key], by=by)
    k = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    return ranked.withColumn("bin", F.floor(((F.col("rank") + 1) * k - 1) / F.col("total")).cast("int")).drop("rank", "total")


def bin_count(n: Column) -> Column:
    """One bin for each 150 rows, from 1 to 10."""
    return F.greatest(F.lit(1), F.least(F.lit(BIN_MAXIMUM), F.floor(n / BIN_MINIMUM))).cast("int")


def bin_table(binned: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("obs_rate"), F.min(p).alias("p_lo"), F.max(p).alias("p_hi"))


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ECE, the count-weighted gap of the bins, and the largest gap."""
    gap = F.abs(F.col("mean_p") - F.col("obs_rate"))
    return bins.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("max_bin_dev"), F.sum("n").alias("n"))


def murphy(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reliability - resolution + uncertainty of binned prices."""
    n = F.sum("n")
    base = F.sum(F.col("obs_rate") * F.col("n")) / n
    reliability = F.sum(F.pow(F.col("mean_p") - F.col("obs_rate"), 2) * F.col("n")) / n
    resolution = F.sum(F.pow("obs_rate", 2) * F.col("n")) / n - base * base
    return bins.groupBy(*by).agg(reliability.alias("reliability"), resolution.alias("resolution"), (base * (1 - base)).alias("uncertainty"), (reliability - resolution + base * (1 - base)).alias("brier_binned"))


def score_set(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """n, Brier score, log loss, and log loss with prices clipped to 0.01 - 0.99."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(squared_error(p, y)).alias("brier"), F.avg(log_loss(p, y)).alias("log_loss"), F.avg(log_loss(p, y, 0.01, 0.99)).alias("clipped_log_loss"))


def quantile_edges(df: DataFrame, n_bins: int, p: str = "p") -> list[float]:
    """Interior edges at even quantiles, each once."""
    shares = [i / n_bins for i in range(1, n_bins)]
    if not shares:
        return []
    found = quantiles(df, p, shares).collect()
    if not found:
        raise ValueError("no rows")
    return sorted({r["q"] for r in found})


def binned_curve(df: DataFrame, edges: Sequence[float], by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Bins by fixed interior edges; a price at an edge is in the upper bin, empty bins have no row."""
    place = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col(p)))
    return bin_table(df.withColumn("bin", place), by, p, y)


#: Parts into which the rows of one value are dealt.
SALTS = 8


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1 by value; ties share the mean of theirs. Rows without a value have none and are left out.

    The table is counted by value. Values are dealt into ranges, each of which
    counts on from the ranges before it, of which there is one number each, so
    no task sees a whole group. Ranks go back to the rows by value and one of
    ``SALTS`` parts of its rows, so a value of most rows is many tasks' work.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    edges = sorted(set(df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], F.lit(20 * n))).first()[0] or [])) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    dealt = counts.withColumn("__part", place).withColumn("__group", F.struct(*by, F.lit(0).alias("__all")))  # null is a group too
    own = F.coalesce(F.sum("__n").over(Window.partitionBy("__group", "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("__group", "__part").agg(F.sum("__n").alias("__size")).groupBy("__group").agg(F.sort_array(F.collect_list(F.struct("__part", "__size"))).alias("__sizes"))  # a number for each range
    before = F.aggregate(F.filter("__sizes", lambda x: x["__part"] < F.col("__part")), F.lit(0).cast("long"), lambda a, x: a + x["__size"])
    ranks = dealt.withColumn("__own", own).join(parts.withColumnRenamed("__group", "__g"), F.col("__group").eqNullSafe(F.col("__g")))
    ranked = ranks.select(*(F.col(c).alias(f"{c}_") for c in (*by, value)), (before + F.col("__own") + (F.col("__n") + 1) / 2).alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt_"))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS)).cast("int"))
    return salted.join(ranked, same([*by, value, "__salt"])).drop("__salt", "__salt_", *(f"{c}_" for c in (*by, value)))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation and number of rows of each group, from rows that have both values; a row for each group goes to the driver."""
    sound = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b).persist()  # read for bounds, counts and ranks
    try:
        ranked = average_ranks(average_ranks(sound, a, "__a", by), b, "__b", by)
        found = ranked.groupBy(*by).agg(F.corr("__a", "__b").alias("rho"), F.count(F.lit(1)).alias("n"))
        return df.sparkSession.createDataFrame(found.collect(), found.schema)
    finally:
        sound.unpersist()


def discrimination(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", least: int = 30) -> DataFrame:
    """Gap of the mean price between won and lost, in standard errors; null for few rows or one class."""
    won, lost = F.when(F.col(y) == 1, F.col(p)), F.when(F.col(y) == 0, F.col(p))
    n1, n0 = F.count(won), F.count(lost)
    gap, se = F.avg(won) - F.avg(lost), F.sqrt(F.var_pop(won) / n1 + F.var_pop(lost) / n0)
    enough = (n1 > 0) & (n0 > 0) & (n1 + n0 >= least)
    return df.groupBy(*by).agg((n1 + n0).alias("n"), gap.alias("gap"), F.when(enough, gap / se).alias("sigmas"))


def pool_shape(df: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Share of prices near a half, mean of p(1-p), range, spread of the logits and mean distance from a half."""
    x = F.col(p)
    return df.groupBy(*by).agg(F.avg(x.between(0.35, 0.65).cast("double")).alias("near_half"), F.avg(x * (1 - x)).alias("mean_variance"), F.min(x).alias("p_min"), F.max(x).alias("p_max"), F.stddev_pop(logit(x)).alias("sd_logit"), F.avg(F.abs(x - 0.5)).alias("mean_distance"))


def baselines(df: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Scores of the constant home rate and of a coin."""
    r = F.avg(y)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("home_rate"), (r * (1 - r)).alias("brier_rate"), (-(r * F.ln(r) + (1 - r) * F.ln(1 - r))).alias("log_loss_rate"), F.lit(0.25).alias("brier_coin"), F.ln(F.lit(2.0)).alias("log_loss_coin"))


def graded(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Forecasts against results: accuracy, Brier score, log loss, and the number right that the forecasts promise."""
    x = F.col(p)
    right = F.when((x >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(squared_error(p, y)).alias("brier"), F.avg(log_loss(p, y, 1e-12)).alias("log_loss"), F.sum(F.greatest(x, 1 - x)).alias("expected_right"))


def risk_tier(model: Column, market: Column) -> Column:
    """Tier of the distance of two prices; null below the first."""
    gap, out = F.abs(model - market), F.when(F.lit(False), "")
    for name, low, high in RISK_TIERS:
        out = out.when((gap >= low) & (gap < high), name)
    return out


def _hit(model: str, market: str, y: str) -> Column:
    """Whether the side that the model prefers to the market won."""
    return F.when(F.col(model) > F.col(market), F.col(y)).otherwise(1 - F.col(y))


def risk_tiers(df: DataFrame, model: str = "p_model", market: str = "p_market", y: str = "y") -> DataFrame:
    """By tier: rows, share in which the side that the model prefers to the market won, mean distance, scores of both."""
    marked = df.withColumn("tier", risk_tier(F.col(model), F.col(market))).where("tier is not null")
    return marked.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(_hit(model, market, y)).alias("hit_rate"), F.avg(F.abs(F.col(model) - F.col(market))).alias("mean_edge"), F.avg(squared_error(model, y)).alias("brier_model"), F.avg(squared_error(market, y)).alias("brier_market"))


def _with_interval(df: DataFrame, found: DataFrame, hit: Column, by: str, reps: int, seed: int) -> DataFrame:
    """``found`` with the 95 % interval of the mean of ``hit``, over resampled rows of each group."""
    draws = hit_rate(df.select(by, hit.cast("double").alias("hit")), "hit", by, reps, seed)
    return found.join(draws.groupBy(by).agg(F.percentile("rate", 0.025).alias("lo"), F.percentile("rate", 0.975).alias("hi")), by)


def risk_tier_intervals(df: DataFrame, model: str = "p_model", market: str = "p_market", y: str = "y", reps: int = 2000, seed: int = 0) -> DataFrame:
    """``risk_tiers`` with the share of all rows, the rows below the first tier, mean prices and results, and the interval of the hit rate."""
    marked = df.withColumn("tier", risk_tier(F.col(model), F.col(market)))
    total = marked.agg(F.count(F.lit(1)).alias("__total"), F.count(F.when(F.col("tier").isNull(), 1)).alias("below_floor"))
    own = marked.where("tier is not null")
    more = own.groupBy("tier").agg(F.avg(model).alias("mean_model"), F.avg(market).alias("mean_market"), F.avg(y).alias("home_rate"))
    out = risk_tiers(df, model, market, y).join(more, "tier").crossJoin(total).withColumn("share", F.col("n") / F.col("__total")).drop("__total")
    return _with_interval(own, out, _hit(model, market, y), "tier", reps, seed)


def _bucket(edges: Sequence[float], p: str) -> Column:
    place = F.when(F.lit(False), 0)
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        place = place.when((F.col(p) >= low) & ((F.col(p) <= high) if high >= 1.0 else (F.col(p) < high)), i)
    return place


def reliability_buckets(df: DataFrame, edges: Sequence[float], p: str = "p", y: str = "y") -> DataFrame:
    """Buckets from edge to edge, closed below and open above, but closed at 1; what lies outside has none."""
    return df.withColumn("bucket", _bucket(edges, p)).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("obs_rate"))


def reliability_intervals(df: DataFrame, edges: Sequence[float], p: str = "p", y: str = "y", reps: int = 2000, seed: int = 0) -> DataFrame:
    """``reliability_buckets`` with the share of all rows and the interval of the observed rate."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    own = df.withColumn("bucket", _bucket(edges, p)).where("bucket is not null")
    out = reliability_buckets(df, edges, p, y).crossJoin(total).withColumn("share", F.col("n") / F.col("__total")).drop("__total")
    return _with_interval(own, out, F.col(y), "bucket", reps, seed)


def clark_west_term(a: str, b: str, y: str = "y") -> Column:
    return squared_error(a, y) - (squared_error(b, y) - F.pow(F.col(a) - F.col(b), 2))


def clark_west(df: DataFrame, a: str, b: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Clark-West terms of two nested forecasts (``a`` the smaller model): their mean, standard error and z."""
    term = clark_west_term(a, b, y)
    mean, se = F.avg(term), F.stddev_samp(term) / F.sqrt(F.count(term))
    return df.groupBy(*by).agg(F.count(term).alias("n"), mean.alias("mean_term"), se.alias("se"), (mean / se).alias("z"))


def clark_west_test(df: DataFrame, a: str, b: str, date: str, y: str = "y", reps: int = 2000, seed: int = 0, mean_block: float = 5.0) -> DataFrame:
    """``clark_west`` with both one-sided levels: of the normal, and of means over dates drawn in runs.

    The drawn means, less the observed one, stand for the null: ``p_bootstrap``
    is how often they reach the observed mean. Fewer than two rows are refused.
    """
    found = clark_west(df, a, b, y).first()
    if found["n"] < 2:
        raise ValueError("fewer than two games")
    mean, se = found["mean_term"], found["se"]
    z = mean / se if se else 0.0
    rows = df.select(F.col(date).alias("date"), clark_west_term(a, b, y).alias("term"))
    dates = rows.agg(F.count_distinct("date").alias("n_dates"))
    drawn = stationary_mean(rows, "term", "date", reps, seed, mean_block).agg(F.avg((F.col("mean") - mean >= mean).cast("double")).alias("p_bootstrap"), F.count(F.lit(1)).alias("reps"))
    fixed = (F.lit(v).alias(k) for k, v in (("n", found["n"]), ("mean_term", mean), ("se", se), ("z", z), ("p_normal", math.erfc(z / math.sqrt(2)) / 2)))
    return drawn.crossJoin(dates).select(*fixed, "p_bootstrap", "n_dates", "reps")


def null_reference(df: DataFrame, n: str = "n", by: str = "sport") -> DataFrame:
    """The tabulated null of the largest n that a sample reaches; below the table the smallest, and ``below_table``."""
    rows = df.sparkSession.createDataFrame(NULL_TABLE, "__sport string, __n long, ece_p99 double, slope_lo double, slope_hi double")
    # a table of fixed size
    table = F.broadcast(rows.groupBy("__sport").agg(F.sort_array(F.collect_list(F.struct("__n", "ece_p99", "slope_lo", "slope_hi"))).alias("__t")))
    reached = F.filter("__t", lambda r: r["__n"] <= F.col(n))
    row = F.when(F.size(reached) > 0, F.element_at(reached, -1)).otherwise(F.element_at("__t", 1))
    out = df.join(table, F.col(by) == F.col("__sport"), "left").withColumn("__r", row)
    return out.select(*df.columns, F.col("__r.__n").alias("ref_n"), "__r.ece_p99", "__r.slope_lo", "__r.slope_hi", (F.size(reached) == 0).alias("below_table"))
