"""Resampling by drawn weights against plain loops over the same weights, at several partitionings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.cox import newton
from plumbline.operators import cox as X
from plumbline.operators import resample


def sample(n, slope, seed=0, places=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.9, n)
    p = np.round(1 / (1 + np.exp(-x)), places).clip(0.01, 0.99)
    q = np.log(p / (1 - p))
    return p, (rng.random(n) < 1 / (1 + np.exp(-slope * q))).astype(float)


def rows(spark, p, y, **more):
    names = ["p", "y", *more]
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(p, y, *more.values(), strict=True)], names)


def drawn(units):
    """The units as arrays, with their weights."""
    t = units.rows.toPandas()
    return t, resample.weights(t["key"].to_numpy(), t["rate"].to_numpy(), units.reps, units.seed) * t["times"].to_numpy()[:, None]


def expanded(t, w, r):
    k = w[:, r].astype(int)
    return np.repeat(t["p"].to_numpy(), k), np.repeat(t["y"].to_numpy(), k)


def test_replicates_against_a_loop_over_drawn_rows(spark):
    p, y = sample(700, 1.2)
    df = rows(spark, p, y)
    got = {r.rep: r for r in resample.bootstrap_scalars(df, 12, seed=4).collect()}
    with resample.Units(df, [], 12, 4) as units:
        t, w = drawn(units)
    for r in range(12):
        a, b = expanded(t, w, r)
        slope, intercept = X.cox(a, b)
        assert (got[r].slope, got[r].intercept) == pytest.approx((slope, intercept), abs=1e-5)
        assert got[r].brier == pytest.approx(np.mean((a - b) ** 2))
        order = np.argsort(a, kind="stable")
        rate = {x: b[a == x].mean() for x in set(a.tolist())}  # rows of one price share their wins
        edges = np.floor(len(a) * np.arange(11) / 10).astype(int)
        gaps = [(j - i, abs(a[order[i:j]].mean() - np.mean([rate[x] for x in a[order[i:j]].tolist()]))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        assert got[r].ece == pytest.approx(sum(n * g for n, g in gaps) / len(a))


def test_the_same_at_any_partitioning_and_by_group(spark):
    (p0, y0), (p1, y1) = sample(300, 1.0, 1), sample(200, 1.5, 2)
    df = rows(spark, np.concatenate([p0, p1]), np.concatenate([y0, y1]), sport=["a"] * 300 + ["b"] * 200)
    names = ["sport", "rep", "ece", "brier", "slope", "intercept"]
    one, other = (sorted(map(tuple, resample.bootstrap_scalars(df.repartition(n), 6, seed=1, by=["sport"]).select(names).collect())) for n in (1, 5))
    assert [r[:2] for r in one] == [(s, i) for s in "ab" for i in range(6)]
    assert np.allclose([r[2:] for r in one], [r[2:] for r in other], atol=1e-9)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        third = sorted(map(tuple, resample.bootstrap_scalars(df, 6, seed=1, by=["sport"]).select(names).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose([r[2:] for r in one], [r[2:] for r in third], atol=1e-9)


def test_intervals_are_those_of_drawing_rows(spark):
    """Against a plain bootstrap of numpy, within what so many replicates can tell."""
    p, y = sample(600, 1.3, 3, places=6)
    rng = np.random.default_rng(9)
    plain = []
    for _ in range(500):
        at = rng.integers(0, 600, 600)
        plain.append((*X.cox(p[at], y[at]), np.mean((p[at] - y[at]) ** 2)))
    lo, hi = np.quantile(plain, [0.025, 0.975], axis=0)
    found = {r.name: r for r in resample.intervals(resample.bootstrap_scalars(rows(spark, p, y), 500), ["slope", "intercept", "brier"]).collect()}
    for i, name in enumerate(("slope", "intercept", "brier")):
        width = hi[i] - lo[i]
        assert abs(found[name].lo - lo[i]) < 0.15 * width and abs(found[name].hi - hi[i]) < 0.15 * width


def test_clusters_count_whole(spark):
    (p0, y0), (p1, y1) = sample(200, 1.4, 1), sample(300, 0.8, 2)
    level, day = ["low"] * 200 + ["high"] * 300, np.arange(500) % 40
    df = rows(spark, np.concatenate([p0, p1]), np.concatenate([y0, y1]), level=level, day=day)
    got = {r.rep: r.difference for r in resample.cluster_slope_difference(df, "level", "day", "low", "high", 8, seed=2).collect()}
    keys = {r.day: r.k for r in df.select("day", F.xxhash64(F.col("day").cast("string")).alias("k")).distinct().collect()}
    w = resample.weights(np.array([keys[d] for d in range(40)]), np.ones(40), 8, 2).astype(int)
    for r in range(8):
        times = w[day, r]
        a, b = (X.cox(np.repeat(p, t), np.repeat(y, t))[0] for p, y, t in ((p0, y0, times[:200]), (p1, y1, times[200:])))
        assert got[r] == pytest.approx(a - b, abs=1e-4)


def test_replicates_without_a_fit(spark):
    df = rows(spark, [0.2, 0.4, 0.6, 0.8], [0.0, 1.0, 0.0, 1.0])
    found = [r.slope for r in resample.bootstrap_scalars(df, 60, seed=1).collect()]
    with resample.Units(df, [], 60, 1) as units:
        t, w = drawn(units)
    for r, slope in enumerate(found):
        try:
            want = X.cox(*expanded(t, w, r))[0]
        except X.FitError:
            want = float("nan")
        assert np.isnan(slope) == np.isnan(want) and (np.isnan(want) or slope == pytest.approx(want, abs=1e-4))
    assert any(map(np.isnan, found)) and not all(map(np.isnan, found))
    with pytest.raises(ValueError):
        resample.bootstrap_scalars(df.limit(0), 5)
    with pytest.raises(ValueError):
        resample.bootstrap_scalars(df.withColumn("p", F.lit(None).cast("double")), 5)


def test_nulls_of_pools_and_sizes(spark):
    p, _ = sample(900, 1.0, 5)
    df = rows(spark, p, np.zeros(900), sport=["a"] * 500 + ["b"] * 400)
    found = resample.simulate_nulls(df, [("a", 300), ("b", 2000), ("all", 900)], reps=60)
    by = {(r.pool, r.n): r for r in found.groupBy("pool", "n").agg(F.avg("slope").alias("slope"), F.stddev("slope").alias("sd"), F.avg("ece").alias("ece"), F.count(F.lit(1)).alias("k")).collect()}
    assert {k: r.k for k, r in by.items()} == {("a", 300): 60, ("b", 2000): 60, ("all", 900): 60}
    assert all(abs(r.slope - 1) < 4 * r.sd / 60**0.5 + 0.05 for r in by.values())
    assert by["a", 300].sd > by["all", 900].sd > by["b", 2000].sd and by["a", 300].ece > by["b", 2000].ece
    with pytest.raises(ValueError):
        resample.simulate_nulls(df, [("c", 5)])


def test_agreement_by_chance_from_numbers_alone(spark):
    df = spark.createDataFrame([("home" if i % 3 else "away", "home" if i % 2 else "away") for i in range(600)], "m string, l string")
    found = resample.shuffled_agreement(df, "m", "l", draws=300).agg(F.avg("agreement"), F.stddev("agreement"), F.max("chance")).first()
    assert found[0] == pytest.approx(0.5, abs=0.01) and found[2] == 0.5
    n = 600  # the number that agree is twice a hypergeometric one, less a constant
    assert found[1] == pytest.approx(2 * (400 * (1 / 2) * (1 / 2) * (n - 400) / (n - 1)) ** 0.5 / n, rel=0.2)


def test_steep_and_flat_fits_over_nodes_agree_with_weighted_ones(spark):
    """All groups are fitted by one pass over few nodes; a slope beyond what nodes resolve takes steps over the units."""
    rng = np.random.default_rng(4)
    rows = []
    for g, slope in (("flat", 0.8), ("steep", 12.0)):
        x = rng.normal(0, 1.5 if g == "flat" else 0.3, 300)
        p, y = 1 / (1 + np.exp(-x)), (rng.random(300) < 1 / (1 + np.exp(-slope * x))).astype(float)
        rows += [(g, float(a), float(b)) for a, b in zip(p, y, strict=True)]
    df = spark.createDataFrame(rows, "g string, p double, y double")
    with resample.Units(df, ["g"], 40, 3) as units:
        shape = resample.shape_of(units)
        slope, intercept = resample.fits(units, shape)
        told = resample._by_nodes(units, shape, np.ones_like(slope, bool))
        own = units.rows.toPandas()
    assert told[2, 0].all() and not told[2, 1].all()
    assert units.rows.rdd.getNumPartitions() > 1
    for i in range(2):
        mine = own[own["g"] == i]
        w = resample.weights(mine["key"].to_numpy(), mine["rate"].to_numpy(), 40, 3)
        for r in range(40):
            x, y, n = (np.repeat(mine[c].to_numpy(), w[:, r].astype(int)) for c in ("x", "y", "x"))
            want = newton(np.column_stack([np.ones(len(n)), x]), y, np.zeros(2))
            assert (intercept[i, r], slope[i, r]) == pytest.approx(tuple(want), abs=1e-5, rel=1e-5)


def test_clusters_are_summed_before_they_are_drawn(spark):
    rng = np.random.default_rng(8)
    n, clusters = 3000, 7
    p = rng.uniform(0.02, 0.98, n)
    df = spark.createDataFrame([(f"d{int(c)}", "low" if i % 3 else "high", float(v), float(rng.random() < v)) for i, (c, v) in enumerate(zip(rng.integers(0, clusters, n), p, strict=True))], "d string, level string, p double, y double").repartition(5).persist()
    with resample.Units(df, ["level"], 40, 3, ["d"]) as units:
        assert units.rows.count() > 2500  # almost each row has a price of its own
        assert units.shapes.count() == 2 * clusters and units.nodes.count() <= 2 * clusters * 18
        shape = resample.shape_of(units)
        slope, intercept = resample.fits(units, shape)
        keys = {r["d"]: r["k"] for r in df.select("d", F.xxhash64(F.coalesce(F.col("d"), F.lit("\0"))).alias("k")).distinct().collect()}
        w = dict(zip(keys, resample.weights(np.array(list(keys.values())), np.ones(clusters), 40, 3), strict=True))
        for g, (level,) in enumerate(units.groups):
            rows = df.where(F.col("level") == level).toPandas()
            times = np.stack([w[d] for d in rows["d"]])
            x = np.log(rows["p"] / (1 - rows["p"])).to_numpy()
            assert np.allclose(shape["n"][g], times.sum(0)) and np.allclose(shape["won_x"][g], (x * rows["y"].to_numpy()) @ times)
            assert np.allclose(shape["loss2"][g], ((rows["p"] - rows["y"]) ** 2).to_numpy() @ times)
            assert np.allclose(shape["won_lo"][g], np.where((times > 0) & (rows["y"].to_numpy() == 1)[:, None], x[:, None], np.inf).min(0))
            eta = intercept[g] + x[:, None] * slope[g]
            residual = times * (rows["y"].to_numpy()[:, None] - 1 / (1 + np.exp(-eta)))
            assert np.abs(residual.sum(0)).max() < 1e-3 and np.abs(x @ residual).max() < 1e-3
