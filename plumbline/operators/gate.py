"""Checks that a census must pass before anything is concluded from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.outcomes import KEY, BooksError, assert_reconciled, content_digest, points_summary
from plumbline.operators.resample import shuffled_agreement
from plumbline.operators.scores import discrimination

#: What the checks allow.
UNCHECKED_SHARE, SIGMAS, HOME_RATE, SHUFFLE_SE, SHUFFLE_ROWS = 0.05, 2.0, (0.35, 0.75), 5.0, 30


class Census(NamedTuple):
    games: DataFrame
    priced: DataFrame
    misses: DataFrame
    quotes: DataFrame


class Result(NamedTuple):
    name: str
    passed: bool
    detail: str


def label_agreement(c: Census) -> Result:
    bad = c.priced.where("label_agreement = 'disagree'").count()
    return Result("label agreement", bad == 0, f"{bad} labels disagree with the schedule")


def complementarity(c: Census) -> Result:
    """No pair of sides may break it; a few may be unchecked, which is null and not false."""
    n, broken, unchecked = c.priced.agg(F.count(F.lit(1)), F.count(F.when(~F.col("complement_ok"), 1)), F.count(F.when(F.col("complement_ok").isNull(), 1))).first()
    return Result("complementarity", n > 0 and broken == 0 and unchecked <= UNCHECKED_SHARE * n, f"{broken} broken, {unchecked} unchecked of {n}")


def reconciliation(c: Census, complete: bool = True) -> Result:
    try:
        assert_reconciled(c.games, c.priced, c.misses, complete)
    except BooksError as e:
        return Result("reconciliation", False, str(e))
    return Result("reconciliation", True, "scheduled = priced + missed")


def price_series(c: Census) -> Result:
    found = points_summary(c.quotes, c.priced).first()
    return Result("price series", not found["missing_series"] and not found["orphan_series"], str(found.asDict()))


def fault_injection(c: Census) -> Result:
    """A double count and a lost game, each put into a copy, must be found, and the census must be as before."""
    before = content_digest(c.priced).first()["digest"]
    victim = c.priced.select(*KEY).orderBy(*KEY).limit(1)
    if victim.isEmpty():
        return Result("fault injection", False, "no priced game to break")
    broken = {
        "double count": c._replace(misses=c.misses.select(*KEY).unionByName(victim)),
        "lost game": c._replace(priced=c.priced.join(victim, list(KEY), "left_anti")),
    }
    unseen = [name for name, census in broken.items() if reconciliation(census).passed]
    same = content_digest(c.priced).first()["digest"] == before
    return Result("fault injection", not unseen and same, f"not found: {unseen}" if unseen else "both faults are found" if same else "the census changed")


def _home_side(c: Census) -> DataFrame:
    return c.priced.where("p_close is not null").join(c.games.select(*KEY, (F.col("winner") == "home").cast("double").alias("y")), list(KEY)).select(F.col("p_close").alias("p"), "y")


def discriminates(c: Census) -> Result:
    found = discrimination(_home_side(c)).first()
    sigmas = found["sigmas"]
    return Result("discrimination", sigmas is not None and sigmas >= SIGMAS, f"{sigmas} standard errors over {found['n']} games")


def shuffled_join(c: Census) -> Result:
    """The market's winners are the league's, and dealt out at random they agree as often as by chance; else the join itself carries labels."""
    rows = c.priced.select(*KEY, F.col("market_winner").alias("market")).join(c.games.select(*KEY, F.col("winner").alias("league")), list(KEY)).dropna()
    n, same, home = rows.agg(F.count(F.lit(1)), F.avg((F.col("market") == F.col("league")).cast("double")), F.avg((F.col("league") == "home").cast("double"))).first()
    if n < SHUFFLE_ROWS:
        return Result("shuffled join", False, f"only {n} games")
    if not HOME_RATE[0] <= home <= HOME_RATE[1]:
        return Result("shuffled join", False, f"home rate {home} over {n} games")
    mean, chance = shuffled_agreement(rows, "market", "league").agg(F.avg("agreement"), F.avg("chance")).first()
    se = (max(chance * (1 - chance), 1e-9) / n) ** 0.5
    return Result("shuffled join", same == 1.0 and abs(mean - chance) <= SHUFFLE_SE * se, f"{same:.4f} agree; shuffled {mean:.4f} against {chance:.4f}")


CHECKS: tuple[Callable[[Census], Result], ...] = (label_agreement, complementarity, reconciliation, price_series, fault_injection, discriminates, shuffled_join)


def run_gate(c: Census, checks: Sequence[Callable[[Census], Result]] = CHECKS) -> list[Result]:
    return [check(c) for check in checks]


def report(results: list[Result]) -> str:
    return "\n".join(f"{'pass' if r.passed else 'FAIL'}  {r.name}: {r.detail}" for r in results)
