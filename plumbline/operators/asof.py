"""As-of joins: for each probe the last build row at or before its time, within equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _instant(df: DataFrame, column: str) -> tuple[Column, int]:
    """A time as a number that keeps all of its precision, and how many of it make a unit of tolerance (a second, for timestamps)."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")), 1_000_000
    if kind == "date":
        return F.unix_date(column), 1
    return F.col(column), 1


def asof_join(probe: DataFrame, build: DataFrame, on: Sequence[str], probe_time: str, build_time: str, *, strict: bool, take: Sequence[str], tolerance: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """``probe`` with the columns ``take`` of its match; null where it has none.

    ``strict`` asks for an earlier time, otherwise an equal one will do; times
    are compared as exactly as they are given. ``tolerance`` bounds the distance,
    in seconds for timestamps, in days for dates, else in the unit of the times.
    Of build rows with one time the last by ``tie`` matches. One shuffle on the
    keys brings both sides together, and one sort; no row is paired with more
    than its match.
    """
    (asked, unit), (known, other) = _instant(probe, probe_time), _instant(build, build_time)
    if unit != other:
        raise ValueError(f"{probe_time} and {build_time} are times of different kinds")
    kept = F.struct(known.alias("__time"), *take)
    sides = [*(F.col(c) for c in on)]
    left = probe.select(*sides, asked.alias("__at"), F.lit(0 if strict else 1).alias("__kind"), F.struct(*probe.columns).alias("__row"), F.lit(None).cast(build.select(kept.alias("x")).schema["x"].dataType).alias("__kept"), *(F.lit(None).cast(build.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(tie)))
    right = build.where(F.col(build_time).isNotNull()).select(*sides, known.alias("__at"), F.lit(1 if strict else 0).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), kept.alias("__kept"), *(F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie)))
    order = Window.partitionBy(*on).orderBy("__at", "__kind", *(f"__tie{i}" for i in range(len(tie)))).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__match", F.last("__kept", ignorenulls=True).over(order)).where("__row is not null")
    match = F.col("__match")
    if tolerance is not None:
        match = F.when(F.col("__at") - F.col("__match.__time") <= tolerance * unit, match)
    # a probe without time has no match
    match = F.when(F.col("__at").isNotNull(), match)
    return found.withColumn("__match", match).select("__row.*", *(F.col(f"__match.{c}").alias(c) for c in take))


def range_history(probe: DataFrame, build: DataFrame, on: Sequence[str], probe_time: str, build_time: str) -> DataFrame:
    """Each probe row beside all strictly earlier build rows with its keys, or nulls; for aggregates over a history at any as-of time."""
    b = build.select(*(F.col(c).alias(f"__b_{c}") for c in build.columns))
    same = [F.col(c) == F.col(f"__b_{c}") for c in on]
    condition = F.col(f"__b_{build_time}") < F.col(probe_time)
    for c in same:
        condition = condition & c
    return probe.join(b, condition, "left")
