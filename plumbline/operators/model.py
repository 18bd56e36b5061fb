"""The game model: design, hierarchical logistic regression by Hamiltonian Monte Carlo, rolling origins, nested tests."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.scalars import inv_logit
from plumbline.operators.cox import CLIP, STEPS, cox
from plumbline.sources.scratch import kept

TERMS = ("rest_diff", "b2b_diff", "travel_diff", "tz_diff", "rating_diff")
#: R-hat above which a fit is refused; chains, warm-up and draws.
MAX_RHAT, CHAINS, WARMUP, SAMPLES = 1.01, 4, 1500, 1500
#: Rows of a likelihood that are taken together, and rows for each parameter from which paths follow its expansion.
BLOCK_ROWS, EXPANDED_ROWS = 1 << 14, 15
#: Order to which sums over a cell go, and a bound of the next derivative of a row's log likelihood.
ORDER, BOUND = 4, 0.128
#: Share of a prior's variance below which effects are walked in as they are, not by their scale.
CENTRED = 0.25
#: Rows of a cell that are summed at once, and share of a deviation within which a mode is found.
CELL_ROWS, NEAR = 1 << 13, 0.05


class DiagnosticsError(RuntimeError):
    """The chains don't agree, or diverged."""


def medians(df: DataFrame, columns: Sequence[str], dev: str) -> dict[str, float]:
    """Medians over the development rows alone; one that has none is refused."""
    found = df.where(dev).agg(*(F.median(c).alias(c) for c in columns)).first()
    if any(found[c] is None for c in columns):
        raise ValueError(f"no median: {[c for c in columns if found[c] is None]}")
    return {c: float(found[c]) for c in columns}


def fill(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Nulls and NaN replaced, and ``filled``, the number of values that were."""
    missing = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in values}
    count = sum((m.cast("int") for m in missing.values()), F.lit(0))
    return df.withColumn("filled", count).withColumns({c: F.when(m, F.lit(v)).otherwise(F.col(c).cast("double")) for (c, m), v in zip(missing.items(), values.values(), strict=True)})


def derive_terms(df: DataFrame) -> DataFrame:
    """Differences, home less away."""
    of = lambda c: F.col(f"home_{c}").cast("double") - F.col(f"away_{c}").cast("double")
    return df.withColumns({"rest_diff": of("rest_days"), "b2b_diff": F.col("home_b2b").cast("int").cast("double") - F.col("away_b2b").cast("int").cast("double"), "travel_diff": of("travel_km"), "tz_diff": of("tz_shift")})


def scaler(df: DataFrame, columns: Sequence[str], dev: str) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation (of the population; 1 where it is 0) of the development rows."""
    found = df.where(dev).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (float(found[f"m_{c}"]), float(found[f"s_{c}"]) or 1.0) for c in columns}


def standardise(df: DataFrame, frozen: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.col(c) - m) / s for c, (m, s) in frozen.items()})


def folds(df: DataFrame, origins: Sequence[int], start: str = "start_t") -> DataFrame:
    """Each row with every fold it belongs to: ``train`` before the origin, ``test`` up to the next one."""
    if sorted(set(origins)) != list(origins):
        raise ValueError("origins ascend")
    ends = [*origins[1:], 2**62]
    role = lambda o, e: F.when(F.col(start) < o, "train").when(F.col(start) < e, "test")
    each = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(o).cast("long").alias("origin"), role(o, e).alias("role")) for i, (o, e) in enumerate(zip(origins, ends, strict=True))))
    return df.select("*", F.inline(F.filter(each, lambda x: x["role"].isNotNull())))


class Data(NamedTuple):
    """Covariates (standardised), rating term, teams as indices, neutral sites, outcomes."""

    x: np.ndarray
    rating: np.ndarray
    home: np.ndarray
    away: np.ndarray
    neutral: np.ndarray
    y: np.ndarray
    teams: int


class Priors(NamedTuple):
    """Standard deviations of the priors."""

    intercept: float = 1.5
    home: float = 0.5
    rating: float = 1.0
    feature: float = 0.5
    team: float = 0.5
    team_home: float = 0.25


def unpack(theta: np.ndarray, d: Data) -> tuple:
    """alpha, mean home edge, rating, features, log scales, and standard effects of teams, overall and at home."""
    k, t = d.x.shape[1], d.teams
    return theta[0], theta[1], theta[2], theta[3 : 3 + k], theta[3 + k], theta[4 + k], theta[5 + k : 5 + k + t], theta[5 + k + t :]


def log_density(theta: np.ndarray, d: Data, q: Priors) -> tuple[float, np.ndarray]:
    """Of the posterior, with its gradient. Effects are non-centred; scales are half-normal, on the log scale."""
    a, m, b, w, lt, lh, zt, zh = unpack(theta, d)
    st, sh = np.exp(min(lt, 20.0)), np.exp(min(lh, 20.0))
    at_home = 1.0 - d.neutral
    eta = a + b * d.rating + d.x @ w + st * (zt[d.home] - zt[d.away]) + at_home * (m + sh * zh[d.home])
    r = d.y - 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    value = float(np.sum(d.y * eta - np.logaddexp(0.0, eta)))
    value += -0.5 * ((a / q.intercept) ** 2 + (m / q.home) ** 2 + (b / q.rating) ** 2 + float(w @ w) / q.feature**2 + float(zt @ zt) + float(zh @ zh))
    value += -0.5 * ((st / q.team) ** 2 + (sh / q.team_home) ** 2) + lt + lh
    team = np.bincount(d.home, r, d.teams) - np.bincount(d.away, r, d.teams)
    host = np.bincount(d.home, r * at_home, d.teams)
    return value, np.concatenate([
        [r.sum() - a / q.intercept**2, (r * at_home).sum() - m / q.home**2, r @ d.rating - b / q.rating**2],
        d.x.T @ r - w / q.feature**2,
        [st * float(team @ zt) - (st / q.team) ** 2 + 1, sh * float(host @ zh) - (sh / q.team_home) ** 2 + 1],
        st * team - zt,
        sh * host - zh,
    ])


def _effects(theta: np.ndarray, d: Data) -> np.ndarray:
    """What the likelihood hangs on: alpha, mean home edge, rating, features, and effects of teams, overall and at home, each times its scale."""
    a, m, b, w, lt, lh, zt, zh = unpack(theta, d)
    return np.concatenate([[a, m, b], w, np.exp(min(lt, 20.0)) * zt, np.exp(min(lh, 20.0)) * zh])


def _blocks(d: Data) -> Iterator[Data]:
    for at in range(0, len(d.y), BLOCK_ROWS):
        yield Data(*(v[at : at + BLOCK_ROWS] for v in d[:-1]), d.teams)


def _eta(effects: np.ndarray, d: Data) -> np.ndarray:
    k = 3 + d.x.shape[1]
    team, host = effects[k : k + d.teams], effects[1] + effects[k + d.teams :]
    return effects[0] + effects[2] * d.rating + d.x @ effects[3:k] + (team[d.home] - team[d.away]) + (1.0 - d.neutral) * host[d.home]


def log_likelihood(effects: np.ndarray, d: Data) -> float:
    """Block by block; the logarithm is taken of products of sixteen chances, none of which is beyond e^36."""
    total = 0.0
    for part in _blocks(d):
        eta = _eta(effects, part)
        odds = 1.0 + np.exp(np.minimum(eta, 36.0))
        whole = len(odds) // 16 * 16
        total += float(part.y @ eta) - float(np.maximum(eta - 36.0, 0.0).sum())
        total -= float(np.log(np.multiply.reduce(odds[:whole].reshape(16, -1), axis=0)).sum() + np.log(odds[whole:]).sum())
    return total


def curvature(effects: np.ndarray, d: Data) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood by the effects, and its second derivatives with the sign turned: sums over the rows, block by block."""
    t, k = d.teams, 3 + d.x.shape[1]
    gradient, matrix = np.zeros(k + 2 * t), np.zeros((k + 2 * t, k + 2 * t))
    both, at_site = np.zeros(t * t), np.zeros(t * t)
    for part in _blocks(d):
        mu = 1 / (1 + np.exp(-np.clip(_eta(effects, part), -700, 700)))
        r, v, here = part.y - mu, mu * (1 - mu), 1.0 - part.neutral
        wide = np.column_stack([np.ones(len(r)), here, part.rating, part.x])
        home, away = (lambda w, c=c: np.bincount(c, w, t) for c in (part.home, part.away))
        gradient += np.concatenate([wide.T @ r, home(r) - away(r), home(r * here)])
        matrix[:k, :k] += wide.T @ (v[:, None] * wide)
        for j in range(k):
            w = v * wide[:, j]
            matrix[j, k:] += np.concatenate([home(w) - away(w), home(w * here)])
        own = np.arange(t)
        matrix[k + own, k + own] += home(v) + away(v)
        matrix[k + own, k + t + own] += home(v * here)
        matrix[k + t + own, k + t + own] += home(v * here * here)
        pair = part.home * t + part.away
        both += np.bincount(pair, v, t * t)
        at_site += np.bincount(pair, v * here, t * t)
    both, at_site = both.reshape(t, t), at_site.reshape(t, t)
    matrix[k : k + t, k : k + t] -= both + both.T
    matrix[k : k + t, k + t :] -= at_site.T
    matrix[k:, :k] = matrix[:k, k:].T
    matrix[k + t :, k : k + t] = matrix[k : k + t, k + t :].T
    return gradient, matrix


@functools.cache
def _powers(p: int, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By degree from 1, products of p variables: each is one of the degree before times a variable; and how often it comes in the power of a sum."""
    out, before = [], {(): 0}
    for d in range(1, order + 1):
        own = list(itertools.combinations_with_replacement(range(p), d))
        often = [math.factorial(d) / math.prod(math.factorial(e.count(j)) for j in set(e)) for e in own]
        out.append((np.array([before[e[:-1]] for e in own]), np.array([e[-1] for e in own]), np.array(often)))
        before = {e: i for i, e in enumerate(own)}
    return out


def _products(z: np.ndarray, order: int) -> list[np.ndarray]:
    """By degree from 0, the products of the columns of z."""
    out = [np.ones((len(z), 1))]
    for parent, variable, _ in _powers(z.shape[1], order):
        out.append(out[-1][:, parent] * z[:, variable])
    return out


def pieces(d: Data) -> np.ndarray:
    """Where pieces begin, in rows that come by sides and site: a cell's rows, or so many of them."""
    turns = np.any([v[1:] != v[:-1] for v in (d.home, d.away, d.neutral)], axis=0)
    heads = np.concatenate([[0], np.flatnonzero(turns) + 1])
    sizes = np.diff(np.append(heads, len(d.y)))
    counts = -(-sizes // CELL_ROWS)
    return np.repeat(heads, counts) + CELL_ROWS * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))


def part_of(d: Data, at: int, to: int) -> Data:
    return Data(*(v[at:to] for v in d[:-1]), d.teams)


def piece_sums(effects: np.ndarray, d: Data, order: int) -> Iterator[tuple[Data, np.ndarray]]:
    """``cell_sums`` of rows that come by sides and site, of some pieces at a time."""
    bounds, i = np.append(pieces(d), len(d.y)), 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CELL_ROWS, side="right")) - 1)
        yield cell_sums(effects, part_of(d, int(bounds[i]), int(bounds[j])), bounds[i:j] - bounds[i], order)
        i = j


def cell_sums(effects: np.ndarray, d: Data, heads: np.ndarray, order: int) -> tuple[Data, np.ndarray]:
    """For each cell, or piece of one (rows of the same sides and site, from a head to the next), a row of it and sums of its rows.

    These are the number of rows, the log likelihood at the effects, a middle of
    rating and covariates, how far rows are from it, products of the fourth
    degree (with the whole order), and by degree and order of the likelihood's
    expansion its terms.
    """
    sizes = np.diff(np.append(heads, len(d.y)))
    z = np.column_stack([d.rating, d.x])
    middles = np.add.reduceat(z, heads, axis=0) / sizes[:, None]
    z = z - np.repeat(middles, sizes, axis=0)
    eta = _eta(effects, d)
    mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    v = mu * (1 - mu)
    terms = np.stack([d.y - mu, -v / 2, -v * (1 - 2 * mu) / 6, -v * (1 - 6 * v) / 24][:order])
    products = np.column_stack(_products(z, order))
    ends = np.cumsum([0, 1, *(len(x[0]) for x in _powers(z.shape[1], order))])
    whole = np.empty((len(heads), order, products.shape[1]))
    for i, (at, n) in enumerate(zip(heads.tolist(), sizes.tolist(), strict=True)):
        np.matmul(terms[:, at : at + n], products[at : at + n], out=whole[i])
    value = np.add.reduceat(d.y * eta - np.logaddexp(0.0, eta), heads)
    fourth = np.add.reduceat(products[:, ends[4] : ends[5]], heads, axis=0) if order == ORDER else np.empty((len(heads), 0))
    of = [whole[:, max(0, k - 1) :, ends[k] : ends[k + 1]].reshape(len(heads), -1) for k in range(order + 1)]
    sums = np.column_stack([sizes, value, middles, np.maximum.reduceat(np.abs(z), heads, axis=0), fourth, *of])
    return Data(*(c[heads] for c in d[:-1]), d.teams), sums


class Cells:
    """The log likelihood around some effects from sums over cells, whatever the number of rows.

    Within a cell the linear predictor of a row moves by what is the cell's and
    by its own distance from the cell's middle times the slopes. So the
    expansion to the fourth order is a polynomial in these, and the fifth
    derivative, which is bounded, says how far it can be from all rows.
    """

    def __init__(self, effects: np.ndarray, d: Data, sums: np.ndarray, order: int = ORDER):
        p, self.order = 1 + d.x.shape[1], order
        self.effects, self.d, self.p = effects, d, p
        self.here = 1.0 - d.neutral
        widths = [p, p, len(_powers(p, order)[3][0]) if order == ORDER else 0]
        size, value, self.middle, reach, fourth, rest = np.split(sums, np.cumsum([1, 1, *widths]), axis=1)
        self.size, self.value = size[:, 0], float(value.sum())
        self.reach, self.fourth, self.terms = reach.max(axis=0), fourth.sum(axis=0), []
        for k, m in enumerate([1, *(len(x[0]) for x in _powers(p, order))]):
            count = order - max(0, k - 1)
            own, rest = rest[:, : count * m], rest[:, count * m :]
            self.terms.append(np.ascontiguousarray(own.reshape(len(sums), count, m).transpose(1, 0, 2)))

    @np.errstate(over="ignore", invalid="ignore")  # a path may end anywhere; what isn't finite is told by the rows
    def log_likelihood(self, effects: np.ndarray) -> tuple[float, float]:
        """Its value, and how far that of all rows is from it at most."""
        move = effects - self.effects
        slopes, d = move[2 : 2 + self.p], self.d
        team, host = move[2 + self.p : 2 + self.p + d.teams], move[1] + move[2 + self.p + d.teams :]
        shift = move[0] + self.middle @ slopes + (team[d.home] - team[d.away]) + self.here * host[d.home]
        powers = [np.ones(len(shift)), shift]
        for _ in range(2, self.order + 1):
            powers.append(powers[-1] * shift)
        total, often = self.value, [np.ones(1), *(x[2] for x in _powers(self.p, self.order))]
        for k, (own, products) in enumerate(zip(self.terms, _products(slopes[None], self.order), strict=True)):
            by_cell = own @ (often[k] * products[0])
            for j, column in enumerate(by_cell, max(1, k)):
                total += math.comb(j, k) * float(powers[j - k] @ column)
        by_rows = max(0.0, float(self.fourth @ (often[4] * products[0]))) * float(np.abs(slopes) @ self.reach)
        norm = float(self.size @ np.abs(powers[4] * shift)) ** 0.2 + by_rows**0.2
        return total, BOUND / 120 * norm**5

    def curvature(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and second derivatives at the effects, as ``curvature`` of all rows has them."""
        d, t, p, here, q = self.d, self.d.teams, self.p, self.here, self.middle
        k = 2 + p
        r, v = self.terms[0][0, :, 0], -2 * self.terms[0][1, :, 0]
        r1, v1 = self.terms[1][0], -2 * self.terms[1][1]
        square = np.zeros((p, p))
        parent, variable, _ = _powers(p, 2)[1]
        square[parent, variable] = square[variable, parent] = -2 * self.terms[2][0].sum(axis=0)
        wide = np.column_stack([v, v * here, v1 + q * v[:, None]])
        matrix = np.zeros((k + 2 * t, k + 2 * t))
        site = np.column_stack([np.ones(len(here)), here])
        matrix[:2, :2] = site.T @ (v[:, None] * site)
        matrix[:2, 2:k] = site.T @ wide[:, 2:]
        matrix[2:k, :2] = matrix[:2, 2:k].T
        matrix[2:k, 2:k] = square + q.T @ v1 + v1.T @ q + q.T @ (v[:, None] * q)
        home, away = (lambda w, c=c: np.bincount(c, w, t) for c in (d.home, d.away))
        gradient = np.concatenate([site.T @ r, (r1 + q * r[:, None]).sum(axis=0), home(r) - away(r), home(r * here)])
        for j in range(k):
            w = wide[:, j]
            matrix[j, k:] += np.concatenate([home(w) - away(w), home(w * here)])
        sides = np.zeros((2, t, t))
        for out, w in zip(sides, (v, v * here), strict=True):
            np.add.at(out, (d.home, d.away), w)
        own = np.arange(t)
        matrix[k + own, k + own] += home(v) + away(v)
        matrix[k + own, k + t + own] += home(v * here)
        matrix[k + t + own, k + t + own] += home(v * here * here)
        matrix[k : k + t, k : k + t] -= sides[0] + sides[0].T
        matrix[k : k + t, k + t :] -= sides[1].T
        matrix[k:, :k] = matrix[:k, k:].T
        matrix[k + t :, k : k + t] = matrix[k : k + t, k + t :].T
        return gradient, matrix


def cells_of(effects: np.ndarray, d: Data, order: int = ORDER) -> Cells:
    """Of rows that are at hand, in any order."""
    place = np.lexsort([d.neutral, d.away, d.home])
    some = list(piece_sums(effects, Data(*(v[place] for v in d[:-1]), d.teams), order))
    return Cells(effects, Data(*map(np.concatenate, zip(*(x[0][:-1] for x in some), strict=True)), d.teams), np.concatenate([x[1] for x in some]), order)


class Expansion(NamedTuple):
    """The log likelihood around some effects, to the second order, and the scales that go with them."""

    effects: np.ndarray
    gradient: np.ndarray
    matrix: np.ndarray
    scales: tuple[float, float]

    def slope(self, effects: np.ndarray) -> np.ndarray:
        return self.gradient - self.matrix @ (effects - self.effects)


def _precision(d: Data, q: Priors, scales: tuple[float, float]) -> np.ndarray:
    each = [q.intercept, q.home, q.rating, *[q.feature] * d.x.shape[1], *[scales[0]] * d.teams, *[scales[1]] * d.teams]
    return 1 / np.array(each) ** 2


def expansion(d: Data, q: Priors, steps: int = 12) -> Expansion:
    """At the mode of the effects, for scales that are led there with them; Newton steps are halved where they are too long."""
    k, t = 3 + d.x.shape[1], d.teams
    effects, scales = np.zeros(k + 2 * t), (q.team / 2, q.team_home / 2)
    for _ in range(steps):
        gradient, matrix = curvature(effects, d)
        precision = _precision(d, q, scales)
        spread = np.linalg.inv(matrix + np.diag(precision))
        change = spread @ (gradient - precision * effects)
        value = lambda e: log_likelihood(e, d) - 0.5 * float(precision @ e**2)  # noqa: B023, E731
        now, share = value(effects), 1.0
        while share > 1e-6 and not value(effects + share * change) >= now - 1e-9 * abs(now):
            share /= 2
        effects = effects + share * change
        second = effects**2 + np.diag(spread)
        scales = tuple(float(np.clip(np.sqrt(second[at].mean()), top / 50, 2 * top)) for at, top in ((slice(k, k + t), q.team), (slice(k + t, None), q.team_home)))
    return Expansion(effects, *curvature(effects, d), scales)


class Search(NamedTuple):
    """Where the way to a mode has come to: effects and scales, the next effects to try, and the density so far."""

    effects: np.ndarray
    scales: tuple[float, float]
    tried: np.ndarray
    value: float
    near: bool


def search(d: Data, q: Priors) -> Search:
    """The start, for the shape of ``d``."""
    none = np.zeros(3 + d.x.shape[1] + 2 * d.teams)
    return Search(none, (q.team / 2, q.team_home / 2), none, -np.inf, False)


def searched(at: Search, cells: Cells, q: Priors) -> Search:
    """A step on: to the mode of the expansion to the second order, and of the scales with it; half way back, where the last one was too long."""
    d, k, t = cells.d, 2 + cells.p, cells.d.teams
    value = cells.value - 0.5 * float(_precision(d, q, at.scales) @ at.tried**2)
    if not value >= at.value - 1e-9 * abs(at.value):
        return at._replace(tried=(at.effects + at.tried) / 2)
    (gradient, matrix), scales, tried = cells.curvature(), at.scales, at.tried
    for _ in range(8):
        precision = _precision(d, q, scales)
        spread = np.linalg.inv(matrix + np.diag(precision))
        tried = at.tried + spread @ (gradient - precision * at.tried)
        second = tried**2 + np.diag(spread)
        scales = tuple(float(np.clip(np.sqrt(second[own].mean()), top / 50, 2 * top)) for own, top in ((slice(k, k + t), q.team), (slice(k + t, None), q.team_home)))
    near = bool(np.max(np.abs(tried - at.tried) / np.sqrt(np.diag(spread))) < NEAR)
    held = cells.value - 0.5 * float(_precision(d, q, scales) @ at.tried**2)
    return Search(at.tried, scales, tried, held, near)


def _from_effects(theta: np.ndarray, d: Data, q: Priors, slope: np.ndarray) -> np.ndarray:
    """The gradient of the posterior, given that of the likelihood by the effects."""
    a, m, b, w, lt, lh, zt, zh = unpack(theta, d)
    st, sh, k = np.exp(min(lt, 20.0)), np.exp(min(lh, 20.0)), 3 + d.x.shape[1]
    team, host = slope[k : k + d.teams], slope[k + d.teams :]
    return np.concatenate([
        [slope[0] - a / q.intercept**2, slope[1] - m / q.home**2, slope[2] - b / q.rating**2],
        slope[3:k] - w / q.feature**2,
        [st * float(team @ zt) - (st / q.team) ** 2 + 1, sh * float(host @ zh) - (sh / q.team_home) ** 2 + 1],
        st * team - zt,
        sh * host - zh,
    ])


def _prior(theta: np.ndarray, d: Data, q: Priors) -> float:
    a, m, b, w, lt, lh, zt, zh = unpack(theta, d)
    st, sh = np.exp(min(lt, 20.0)), np.exp(min(lh, 20.0))
    return -0.5 * ((a / q.intercept) ** 2 + (m / q.home) ** 2 + (b / q.rating) ** 2 + float(w @ w) / q.feature**2 + float(zt @ zt) + float(zh @ zh) + (st / q.team) ** 2 + (sh / q.team_home) ** 2) + lt + lh


def hmc(d: Data, q: Priors, rng: np.random.Generator, warmup: int, samples: int, accept: float = 0.9, around: Expansion | None = None, cells: Cells | None = None, rows: Callable[[np.ndarray], float] | None = None) -> tuple[np.ndarray, int]:
    """Draws and divergences of one chain: paths of random length, step size by dual averaging, diagonal metric from the warm-up.

    Paths are taken in coordinates in which the posterior around its mode is
    round. Effects that the rows tell well are walked in as they are, as their
    scale would move them all; the others by their scale. With many rows for each parameter they follow the gradient of the
    expansion instead of the rows' own; any gradient gives paths that can be
    taken back. Whether a path's end is taken is judged by the density of all
    rows: sums over cells, where they are told, do so within a bound, and where it leaves the
    verdict open the rows themselves are passed over. So every verdict is that
    which all rows give, and few draws meet them.

    ``around``, ``cells`` and ``rows``, the log likelihood of all rows, may be
    told; then ``d`` gives no more than the shape.
    """
    given, k, t = cells is not None, d.x.shape[1], d.teams
    around = around or expansion(d, q)
    n = 5 + k + 2 * t
    spread = np.diag(np.linalg.inv(around.matrix + np.diag(_precision(d, q, around.scales))))
    blocks = [(3 + k + i, slice(5 + k + i * t, 5 + k + (i + 1) * t)) for i, s in enumerate(around.scales) if given and spread[3 + k + i * t : 3 + k + (i + 1) * t].mean() < CENTRED * s**2]  # those walked in as they are
    scale, own_scale = np.concatenate([np.ones(3 + k), np.full(t, around.scales[0]), np.full(t, around.scales[1])]), np.full(2, 0.5)
    for at, own in blocks:
        scale[own.start - 2 : own.stop - 2], own_scale[at - 3 - k] = 1.0, 1 / np.sqrt(2 * t)
    mode = np.insert(around.effects / scale, 3 + k, np.log(around.scales))
    rest = np.r_[0 : 3 + k, 5 + k : n]
    turn = np.diag(np.concatenate([np.zeros(3 + k), own_scale, np.zeros(2 * t)]))  # the scales by themselves
    turn[np.ix_(rest, rest)] = np.linalg.cholesky(np.linalg.inv(scale[:, None] * around.matrix * scale + np.diag(scale**2 * _precision(d, q, around.scales))))

    def place(x: np.ndarray) -> np.ndarray:
        theta = mode + turn @ x
        for at, own in blocks:
            theta[own] *= np.exp(-theta[at])
        return theta

    def turned(theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        for at, own in blocks:
            gradient[at] -= float(gradient[own] @ theta[own]) + t
            gradient[own] *= np.exp(-theta[at])
        return turn.T @ gradient

    volume = lambda theta: -t * sum(theta[at] for at, _ in blocks)
    if given or len(d.y) >= EXPANDED_ROWS * n:
        rows = rows or (lambda e: log_likelihood(e, d))
        slope = lambda x: turned(theta := place(x), _from_effects(theta, d, q, around.slope(_effects(theta, d))))
        density = lambda x: rows(_effects(theta := place(x), d)) + _prior(theta, d, q) + volume(theta)
    else:
        slope = lambda x: turned(theta := place(x), log_density(theta, d, q)[1])
        density = lambda x: log_density(theta := place(x), d, q)[0] + volume(theta)
    told = lambda x: (density(x), 0.0)
    if given:
        told = lambda x: (lambda theta, v: (v[0] + _prior(theta, d, q) + volume(theta), v[1]))(theta := place(x), cells.log_likelihood(_effects(theta, d)))
    theta = rng.normal(0, 1, n)
    (value, doubt), gradient = told(theta), slope(theta)
    metric, step = np.ones(n), 0.1
    mu, bar, h, count = np.log(10 * step), 0.0, 0.0, 0
    seen, out, divergences = [], [], 0
    for i in range(warmup + samples):
        momentum = rng.normal(0, 1, n) / np.sqrt(metric)
        start = 0.5 * float(momentum**2 @ metric)
        length = max(1, int(rng.uniform(0.5, 1.5) * 1.6 / step)) if step > 0 else 1
        x, g, p = theta, gradient, momentum
        for _ in range(min(length, 200)):
            p = p + 0.5 * step * g
            x = x + step * metric * p
            g = slope(x)
            p = p + 0.5 * step * g
            if not np.all(np.isfinite(p)):
                break
        chance = rng.random()
        if np.all(np.isfinite(p)) and np.all(np.isfinite(x)):
            new, open_ = told(x)
            end = 0.5 * float(p**2 @ metric)
            verdicts = {(chance < np.exp(min(0.0, v)), v < -1000) for s in (-1, 1) for v in [new - end - (value - start) + s * (doubt + open_)]} if np.isfinite(new + open_) else ()
            if given and len(verdicts) != 1:
                if doubt:
                    value, doubt = density(theta), 0.0
                new, open_ = density(x), 0.0
            gain = new - end - (value - start) if np.isfinite(new) and new - end - (value - start) >= -1000 else -np.inf
        else:
            gain = -np.inf
        rate = float(np.exp(min(0.0, gain)))
        if gain == -np.inf and i >= warmup:
            divergences += 1
        if chance < rate:
            theta, value, doubt, gradient = x, new, open_, g
        if i < warmup:
            count += 1
            h += (accept - rate - h) / (count + 10)
            log_step = mu - np.sqrt(count) / 0.05 * h
            share = count**-0.75
            bar = share * log_step + (1 - share) * bar
            step = float(np.exp(log_step))
            if i > warmup // 4:
                seen.append(theta)
            if i in (warmup // 2, warmup * 3 // 4) and len(seen) > 20:
                metric = np.var(np.array(seen), axis=0) + 1e-3
                mu, bar, h, count = np.log(10 * step), 0.0, 0.0, 0
            if i == warmup - 1:
                step = float(np.exp(bar))
        else:
            out.append(place(theta))
    return np.array(out), divergences


def diagnostics(draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By group, R-hat of each parameter from means and variances of the chains, and divergences. A parameter without variance has an infinite one."""
    values = draws.select(*by, "chain", "divergences", F.posexplode("values").alias("parameter", "v"))
    each = values.groupBy(*by, "parameter", "chain").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.count("v").alias("n"), F.max("divergences").alias("bad"))
    n = F.first("n")
    within, between = F.avg("s"), F.var_samp("m")
    rhat = F.sqrt((n - 1) / n + between / within)
    sound = F.when(F.isnan(rhat) | rhat.isNull(), F.lit(float("inf"))).otherwise(rhat)
    return each.groupBy(*by, "parameter").agg(sound.alias("rhat"), F.sum("bad").alias("divergences"), F.count(F.lit(1)).alias("chains"))


def effective_size(chains: np.ndarray) -> float:
    """Independent draws that chains (rows) of one parameter are worth, by the autocorrelation up to the first pair of lags whose sum isn't positive."""
    m, n = chains.shape
    centred = chains - chains.mean(axis=1, keepdims=True)
    spectrum = np.abs(np.fft.rfft(centred, 2 * n, axis=1)) ** 2
    covariance = np.fft.irfft(spectrum, axis=1)[:, :n].mean(axis=0) / n
    variance = covariance[0] + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if not variance > 0:
        return float("nan")
    rho = 1 - (covariance[0] - covariance) / variance
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = int(np.argmax(pairs <= 0)) if np.any(pairs <= 0) else len(pairs)
    return float(m * n / max(1.0, 2 * pairs[:stop].sum() - 1))


def effective_sizes(draws: DataFrame) -> DataFrame:
    """``parameter`` and ``ess``; a parameter's draws are bounded by the length of the chains."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chains = rows.sort_values(["chain", "draw"]).pivot(index="chain", columns="draw", values="v").to_numpy()
        return pd.DataFrame({"parameter": [rows["parameter"].iloc[0]], "ess": [effective_size(chains)]})

    values = draws.select("chain", "draw", F.posexplode("values").alias("parameter", "v"))
    return values.groupBy("parameter").applyInPandas(run, "parameter int, ess double")


def recalibration_null(p_fit: np.ndarray, y_fit: np.ndarray, p_apply: np.ndarray) -> np.ndarray:
    """Prices recalibrated by a fit on earlier games."""
    slope, intercept = cox(p_fit, y_fit)
    q = np.clip(p_apply, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(intercept + slope * np.log(q / (1 - q)))))


def _logistic_sums(name: str, x: Sequence[Column], y: Column) -> list[Column]:
    """Aggregates of loss, gradient and upper Hessian of a logistic model at the coefficients ``{name}0``, ``{name}1`` and so on."""
    eta = functools.reduce(lambda s, t: s + t, (F.col(f"{name}{i}") * v for i, v in enumerate(x)))
    mu = inv_logit(eta)
    terms = [F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta, *((mu - y) * v for v in x), *(mu * (1 - mu) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x)))]
    return [F.sum(t).alias(f"{name}s{i}") for i, t in enumerate(terms)]


class _Newton:
    """Newton steps of one group's model as sums come in; the fit of ``logistic_mle``."""

    def __init__(self, d: int, n: int):
        self.d, self.n, self.ridge, self.tolerance = d, n, 1e-8, 1e-8
        self.beta, self.last, self.best, self.failure, self.open = np.zeros(d), np.zeros(d), np.inf, None, True

    def close(self, failure: str | None = None) -> None:
        self.open, self.failure = False, failure

    def meet(self, sums: Sequence[float]) -> None:
        d, hessian = self.d, np.empty((self.d, self.d))
        loss, gradient = sums[0] + self.ridge * float(self.beta @ self.beta) / 2, np.array(sums[1 : d + 1]) + self.ridge * self.beta
        if not loss <= self.best * (1 + 1e-12):  # the step was too long
            self.beta = (self.last + self.beta) / 2
            return self.close("no convergence") if np.max(np.abs(self.beta - self.last)) < 1e-12 else None
        self.last, self.best = self.beta, loss
        if np.max(np.abs(gradient)) < self.tolerance * max(1.0, self.n**0.5):
            return self.close()
        at = np.triu_indices(d)
        hessian[at] = hessian.T[at] = sums[d + 1 :]
        try:
            self.beta = self.beta - np.linalg.solve(hessian + self.ridge * np.eye(d), gradient)
        except np.linalg.LinAlgError:
            return self.close("singular")
        return self.close("diverges") if not np.all(np.isfinite(self.beta)) or np.max(np.abs(self.beta)) > 1e4 else None


def rolling_nested(df: DataFrame, origins: Sequence[int], covariates: Sequence[str], by: Sequence[str] = ("sport",), price: str = "p", y: str = "y", key: str = "game_id") -> DataFrame:
    """Out-of-fold forecasts of a model of the price alone (``p_a``) and one with covariates (``p_b``).

    A fold whose training or test rows are missing, or that has no fit, gives
    no forecast but one row that names why. Newton steps of all folds and both
    models are taken together: a step is one aggregate of sums by fold. Rows
    stay where they are; a few numbers for each fold go to the driver.
    """
    spark, groups = df.sparkSession, [*(f"__b{i}" for i in range(len(by))), "fold"]
    told = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (price, y, *covariates)))
    wide = [F.lit(1.0), F.col("__x"), *(F.col(f"__z{i}") for i in range(len(covariates)))]
    cut = F.least(F.greatest(F.col(price).cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    each = folds(df, origins).select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=False)), "fold", "role", F.col(key).alias("__key"), told.alias("told"), F.ln(cut / (1 - cut)).alias("__x"), *(F.col(c).cast("double").alias(f"__z{i}") for i, c in enumerate(covariates)), F.col(y).cast("double").alias("__y"))
    rows = kept(each, "nested")
    sizes = rows.groupBy(*groups).agg(*(F.count(F.when(F.col("told") & (F.col("role") == r), 1)).alias(r) for r in ("train", "test"))).collect()
    fits = {tuple(r[g] for g in groups): [_Newton(d, r["train"]) for d in (2, len(wide))] for r in sizes}
    for r in sizes:
        if not r["train"] or not r["test"]:
            for f in fits[tuple(r[g] for g in groups)]:
                f.close("no rows to train on" if not r["train"] else "no rows to test on")
    names = [("a", 2), ("b", len(wide))]
    coefficients = [f"{m}{i}" for m, d in names for i in range(d)]

    def meeting(rows: DataFrame, some: Sequence[tuple]) -> DataFrame:
        kinds = functools.reduce(lambda s, g: s.add(f"{g}_", rows.schema[g].dataType), groups, StructType()).add("g", "integer")
        kinds = functools.reduce(lambda s, c: s.add(c, "double"), coefficients, kinds)
        table = spark.createDataFrame([(*k, i, *(float(v) for f in fits[k] for v in f.beta)) for i, k in enumerate(some)], kinds)
        same = functools.reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups))
        return rows.join(F.broadcast(table), same)  # a row for each fold

    for _ in range(2 * STEPS):
        some = [k for k, v in fits.items() if any(f.open for f in v)]
        if not some:
            break
        sums = [c for m, d in names for c in _logistic_sums(m, wide[:d], F.col("__y"))]
        for r in meeting(rows.where("told and role = 'train'"), some).groupBy("g").agg(*sums).collect():
            for (m, d), f in zip(names, fits[some[r["g"]]], strict=True):
                if f.open:
                    f.meet([r[f"{m}s{i}"] for i in range(1 + d + d * (d + 1) // 2)])
    why = {k: next((f.failure or ("no convergence" if f.open else None) for f in v if f.failure or f.open), None) for k, v in fits.items()}
    apply = lambda m, d: inv_logit(functools.reduce(lambda s, t: s + t, (F.col(f"{m}{i}") * v for i, v in enumerate(wide[:d]))))
    own = [F.col(g).alias(c) for c, g in zip(by, groups, strict=False)]
    found = meeting(rows.where("told and role = 'test'"), [k for k, v in why.items() if v is None]).select(*own, F.col("fold").cast("int").alias("fold"), F.col("__key").alias(key), F.col("__y").alias("y"), *(apply(m, d).alias(f"p_{m}") for m, d in names), F.lit(None).cast("string").alias("skipped"))
    lacking = functools.reduce(lambda s, g: s.add(g, rows.schema[g].dataType), groups, StructType()).add("skipped", "string")
    none = spark.createDataFrame([(*k, v) for k, v in why.items() if v is not None], lacking)
    return found.unionByName(none.select(*own, F.col("fold").cast("int").alias("fold"), "skipped"), allowMissingColumns=True)


def gbm_ceiling(df: DataFrame, features: Sequence[str], train: str, y: str = "y", key: str = "game_id", rounds: int = 40) -> DataFrame:
    """Forecasts of boosted trees for the rows that aren't trained on: what the features could give at best."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    model = GBTClassifier(labelCol=y, maxIter=rounds, stepSize=0.05, maxDepth=3, minInstancesPerNode=20, seed=7).fit(rows.where(train))
    return model.transform(rows.where(~F.expr(train))).select(key, y, vector_to_array("probability")[1].alias("p"))


def rolling_ceiling(df: DataFrame, origins: Sequence[int], features: Sequence[str], y: str = "y", key: str = "game_id", rounds: int = 40) -> DataFrame:
    """``gbm_ceiling`` at each origin, trained on what started before it: fold, key, y, p.

    A fold that has nothing to train on or to test is refused. Nothing of a
    fold's test rows goes into its trees.
    """
    rows = folds(df.where(F.col(y).isNotNull()), origins)
    sizes = {(r["fold"], r["role"]) for r in rows.select("fold", "role").distinct().collect()}
    empty = [(i, role) for i in range(len(origins)) for role in ("train", "test") if (i, role) not in sizes]
    if empty:
        raise ValueError(f"folds with an empty side: {empty}")
    out = None
    for i in range(len(origins)):
        one = gbm_ceiling(rows.where(F.col("fold") == i), features, "role = 'train'", y, key, rounds).select(F.lit(i).alias("fold"), key, y, "p")
        out = one if out is None else out.unionByName(one)
    return out
