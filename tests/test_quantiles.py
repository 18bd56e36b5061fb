"""Quantiles by selection against percentile, to the bit; ranks with many ties; the plans behind them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import scores as C
from plumbline.operators.frame import median_split, with_week
from plumbline.operators.quantiles import quantiles


def rows(spark):
    rng = np.random.default_rng(0)
    out = [("even", float(v)) for v in rng.normal(size=301)] + [("ties", float(v)) for v in rng.integers(0, 3, 200)] + [("one", 7.5)] + [(None, float(i)) for i in range(10)]
    out += [("wide", float(v)) for v in np.concatenate([10.0 ** rng.uniform(-300, 300, 60), -(10.0 ** rng.uniform(-300, 300, 41))])] + [("huge", -1.7e308), ("huge", 1.7e308), ("huge", 3.0)]
    return spark.createDataFrame([*out, ("even", None), ("none", None), ("ties", float("nan"))], "g string, v double")


@pytest.mark.parametrize("buckets", [64, 1024])
def test_as_percentile_to_the_bit(spark, buckets):
    df, shares = rows(spark).repartition(5), [0.0, 0.025, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.share): r.q for r in quantiles(df, "v", shares, ["g"], buckets).collect()}
    plain = df.where("not isnan(v)").groupBy("g").agg(*(F.percentile("v", s).alias(str(i)) for i, s in enumerate(shares))).collect()
    assert got == {(r.g, s): r[str(i)] for r in plain if r.g != "none" for i, s in enumerate(shares)}
    whole = quantiles(df.where("g in ('even', 'ties')"), "v", [0.3], buckets=buckets).first()
    assert whole.q == df.where("g in ('even', 'ties') and not isnan(v)").agg(F.percentile("v", 0.3)).first()[0]


def test_what_has_no_quantile(spark):
    df = rows(spark)
    assert quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0 and quantiles(df.where("g = 'none'"), "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles(df, "v", [1.5])
    with pytest.raises(ValueError):
        quantiles(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), "v", [0.5])


def test_splits_at_the_median_of_groups(spark):
    df = rows(spark).where("v is null or not isnan(v)")
    got = sorted(map(tuple, median_split(df, "v", ("g",), "low", "high", "side").collect()), key=str)
    middle = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    want = [(r.g, r.v, None if r.v is None else "low" if r.v <= middle[r.g] else "high") for r in df.collect()]
    assert got == sorted(want, key=str)
    assert "Window" not in median_split(df, "v", ("g",), "low", "high", "side")._jdf.queryExecution().optimizedPlan().toString()
    games = spark.createDataFrame([("nba", "24", "2024-10-22"), ("nba", "24", "2024-10-28"), ("nba", "24", "2024-10-29"), ("nba", None, "2024-11-05")], "sport string, season string, d string").withColumn("et_date", F.to_date("d")).drop("d")
    weeks = with_week(games)
    assert sorted(r.week_of_season for r in weeks.collect()) == [1, 1, 1, 2] and "Window" not in weeks._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_a_value_that_most_rows_have(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(900) < 0.6, 0.5, np.round(rng.random(900), 2))
    df = spark.createDataFrame([(i, "a" if i % 3 else None, float(x)) for i, x in enumerate(v)], "i int, g string, v double").repartition(4)
    for by in ([], ["g"]):
        got = {r.i: r.rank for r in C.average_ranks(df, "v", "rank", by).collect()}
        assert len(got) == 900
        for part in ([np.arange(900)] if not by else [np.arange(900) % 3 > 0, np.arange(900) % 3 == 0]):
            at = np.flatnonzero(part) if part.dtype == bool else part
            x = v[at]
            want = [(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x]
            assert [got[i] for i in at.tolist()] == want
    plan = C.average_ranks(df, "v", "rank")._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", plan)
    assert windows and all("__part" in x for x in windows)  # none over a whole group
    assert C.average_ranks(df.limit(0), "v", "rank").count() == 0
