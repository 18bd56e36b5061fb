"""Logistic fits with guards: recalibration on the logit scale, and general maximum likelihood."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from plumbline.functions.scalars import inv_logit, logit

CLIP, TOLERANCE, STEPS = 1e-6, 1e-6, 60


class FitError(ValueError):
    """The data don't determine a fit."""


def _loss(eta: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0.0, eta) - y * eta))


def newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 0.0, tolerance: float = TOLERANCE, steps: int = STEPS) -> np.ndarray:
    """Maximum likelihood of a logistic model by Newton steps, halved until the loss falls."""
    beta = start.astype(float)
    loss = lambda b: _loss(x @ b, y) + ridge * float(b @ b) / 2
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        gradient = x.T @ (mu - y) + ridge * beta
        if np.max(np.abs(gradient)) < tolerance * max(1.0, len(y) ** 0.5):
            return beta
        hessian = (x * (mu * (1 - mu))[:, None]).T @ x + ridge * np.eye(len(beta))
        try:
            step = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError as e:
            raise FitError("singular") from e
        now, share = loss(beta), 1.0
        while share > 1e-10 and not loss(beta - share * step) <= now:
            share /= 2
        beta = beta - share * step
        if not np.all(np.isfinite(beta)) or np.max(np.abs(beta)) > 1e4:
            raise FitError("diverges")
    raise FitError("no convergence")


def cox(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of y on the logit of p; 1 and 0 for calibrated prices.

    Raises FitError for no rows, one class, constant prices, or prices that
    separate the classes.
    """
    p, y = np.asarray(p, float), np.asarray(y, float)
    if len(p) != len(y) or not len(p):
        raise FitError("no rows, or not as many prices as outcomes")
    rate = y.mean()
    q = np.clip(p, CLIP, 1 - CLIP)
    x = np.log(q / (1 - q))
    if rate in (0.0, 1.0):
        raise FitError("one class")
    if np.ptp(x) < 1e-9:
        raise FitError("constant prices")
    won, lost = x[y == 1], x[y == 0]
    if won.min() >= lost.max() or lost.min() >= won.max():
        raise FitError("separable")
    beta = newton(np.column_stack([np.ones_like(x), x]), y, np.array([np.log(rate / (1 - rate)), 0.0]))
    return float(beta[1]), float(beta[0])


def logistic_mle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and coefficients, with a trace of ridge for collinear columns."""
    x = np.column_stack([np.ones(len(y)), np.asarray(x, float)])
    return newton(x, np.asarray(y, float), np.zeros(x.shape[1]), ridge=1e-8, tolerance=1e-8)


def cox_by(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Slope and intercept of each group, null with the reason where there is no fit. Rows without a price or outcome take no part.

    Rows of a group with the same price and outcome are folded into one with
    their number. Newton steps of all groups are then taken together: a step is
    one aggregate of six sums by group, halved where the loss rose. So no task
    holds a group, whatever its size; a row for each group goes to the driver.
    """
    schema = df.select(*by).schema.add("n", "long").add("slope", "double").add("intercept", "double").add("failure", "string")
    keys = [f"__b{i}" for i in range(len(by))]
    told = F.col(p).isNotNull() & F.col(y).isNotNull()
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.when(told, logit(p, CLIP)).alias("x"), F.when(told, F.col(y).cast("double")).alias("y"))
    folded = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        return df.sparkSession.createDataFrame(_fit(folded, keys), schema)
    finally:
        folded.unpersist()


def _fit(folded: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """(*group, n, slope, intercept, failure) of each group of folded rows (x, y, n)."""
    spark, own = folded.sparkSession, lambda mask: F.when(mask, F.col("x"))
    won, lost = own(F.col("y") == 1), own(F.col("y") == 0)
    count = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0))
    shape = folded.groupBy(*keys).agg(count.alias("__n"), (F.sum(F.col("y") * F.col("n")) / count).alias("rate"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(won).alias("won_lo"), F.max(won).alias("won_hi"), F.min(lost).alias("lost_lo"), F.max(lost).alias("lost_hi")).collect()
    groups, out = [tuple(r[k] for k in keys) for r in shape], []
    a, b, n = np.zeros(len(shape)), np.zeros(len(shape)), np.array([r["__n"] for r in shape], float)
    for i, r in enumerate(shape):
        why = "no rows, or not as many prices as outcomes" if not r["__n"] else "one class" if r["rate"] in (0.0, 1.0) else "constant prices" if r["hi"] - r["lo"] < 1e-9 else "separable" if r["won_lo"] >= r["lost_hi"] or r["lost_lo"] >= r["won_hi"] else None
        out.append((int(r["__n"]), None, None, why))
        if why is None:
            a[i] = np.log(r["rate"] / (1 - r["rate"]))
    open_ = np.array([o[3] is None for o in out], bool)
    kinds = StructType([StructField(k, folded.schema[k].dataType) for k in keys] + [StructField("g", IntegerType()), StructField("a", DoubleType()), StructField("b", DoubleType())])
    eta = F.col("a") + F.col("b") * F.col("x")
    mu = inv_logit(eta)
    w, d = F.col("n") * mu * (1 - mu), F.col("n") * (mu - F.col("y"))
    loss = F.col("n") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - F.col("y") * eta)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate((d, d * F.col("x"), w, w * F.col("x"), w * F.col("x") * F.col("x"), loss))]
    a0, b0, best = a.copy(), b.copy(), np.full(len(a), np.inf)
    for _ in range(2 * STEPS):
        on = np.flatnonzero(open_)
        if not len(on):
            break
        at = spark.createDataFrame([(*groups[i], int(i), float(a[i]), float(b[i])) for i in on], kinds) if keys else None
        meeting = folded.where("x is not null")
        if keys:
            meeting = meeting.join(F.broadcast(at.withColumnsRenamed({k: f"{k}_" for k in keys})), _same(keys))  # a row for each group
        else:
            meeting = meeting.withColumns({"g": F.lit(0), "a": F.lit(float(a[0])), "b": F.lit(float(b[0]))})
        for r in meeting.groupBy("g").agg(*sums).collect():
            i, (g0, g1, h0, h1, h2, now) = r["g"], (r[f"s{j}"] for j in range(6))
            if not now <= best[i] * (1 + 1e-12):  # the step was too long
                a[i], b[i] = (a0[i] + a[i]) / 2, (b0[i] + b[i]) / 2
                if max(abs(a[i] - a0[i]), abs(b[i] - b0[i])) < 1e-12:
                    open_[i], out[i] = False, (out[i][0], None, None, "no convergence")
                continue
            a0[i], b0[i], best[i], det = a[i], b[i], now, h0 * h2 - h1 * h1
            if max(abs(g0), abs(g1)) < TOLERANCE * max(1.0, n[i] ** 0.5):
                open_[i], out[i] = False, (out[i][0], float(b[i]), float(a[i]), None)
            elif det <= 1e-12 * max(1.0, h0 * h2) or max(abs(a[i]), abs(b[i])) > 1e4:
                open_[i], out[i] = False, (out[i][0], None, None, "diverges")
            else:
                a[i], b[i] = a[i] - (h2 * g0 - h1 * g1) / det, b[i] - (h0 * g1 - h1 * g0) / det
    return [(*g, *((o[0], None, None, "no convergence") if open_[i] else o)) for i, (g, o) in enumerate(zip(groups, out, strict=True))]


def _same(keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))


def cox_table(df: DataFrame, p: str = "p", y: str = "y") -> tuple[float, float]:
    """Slope and intercept of a table of any size; raises FitError where ``cox_by`` tells a reason."""
    found = cox_by(df, [], p, y).first()
    if found is None or found["failure"]:
        raise FitError(found["failure"] if found else "no rows")
    return found["slope"], found["intercept"]


def recalibrated(df: DataFrame, slope: float, intercept: float, p: str = "p", out: str = "p_recal") -> DataFrame:
    return df.withColumn(out, inv_logit(F.lit(intercept) + F.lit(slope) * logit(p)))
