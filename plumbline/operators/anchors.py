"""Ticks to the few prices that matter: the last at or before each horizon before the start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.asof import asof_join
from plumbline.schemas import HORIZONS

KEYS = ("sport", "season", "game_id", "side")


def anchors_wide(quotes: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """For each series, one row: tip_t, n_pre_tipoff, and price and time at each horizon (null where it has none).

    Ticks are reduced before the shuffle, by partial aggregation; of the starts
    only those are asked that have a tick. Null prices are no ticks; of ticks at
    one time that with the largest price counts.
    """
    # one number that sorts by time, then price, so that the aggregate keeps its hash table
    order = F.col("t").cast("decimal(20,0)") + (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))) / 2).cast("decimal(18,17)")
    by = [k for k in keys if k in starts.columns]
    held = quotes.join(starts.select(*by, "tip_t"), by)
    last = []
    for name, seconds in horizons.items():
        seen = (F.col("t") <= F.col("tip_t") - seconds) & F.col("p").isNotNull()
        last += [F.max_by(F.when(seen, F.col("p")), F.when(seen, order)).alias(f"p_{name}"), F.max(F.when(seen, F.col("t"))).alias(f"t_{name}")]
    return held.groupBy(*keys).agg(F.max("tip_t").alias("tip_t"), F.count(F.when((F.col("t") <= F.col("tip_t")) & F.col("p").isNotNull(), 1)).alias("n_pre_tipoff"), *last)


def anchors_long(wide: DataFrame, keys: Sequence[str] = KEYS, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One row for each horizon that has a price."""
    each = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(s).cast("long").alias("horizon_secs"), F.col(f"t_{n}").alias("quote_t"), F.col(f"p_{n}").alias("p")) for n, s in horizons.items()))
    rows = wide.select(*keys, "tip_t", "n_pre_tipoff", F.inline(each))
    return rows.where("p is not null").withColumn("secs_before_tip", F.col("tip_t") - F.col("quote_t"))


def price_as_of(anchors: DataFrame, probes: DataFrame, as_of: str = "as_of", keys: Sequence[str] = KEYS) -> DataFrame:
    """For each probe the latest anchor quoted at or before its time; probes without one stay, with nulls."""
    return asof_join(probes, anchors, keys, as_of, "quote_t", strict=False, take=["horizon", "quote_t", "p"], tie=["horizon_secs"])


def price_table(anchors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``anchors`` in order of series, the farthest horizon first."""
    return anchors.orderBy(*keys, F.desc("horizon_secs"))
