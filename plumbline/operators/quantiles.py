"""Exact quantiles of all groups at once, by selection: no task holds a group, and no sort is made."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Buckets into which the range around a wanted rank is cut in each pass.
BUCKETS = 1024


def same(keys: Sequence[str], other: str = "_") -> Column:
    """Equality of columns with their namesakes; null equals null."""
    return functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}{other}")) for k in keys), F.lit(True))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``by``, share and q: the value of ``percentile(value, share)`` of each group, to the bit.

    Each wanted rank has a range of values that it lies in, at first the whole
    one. A pass counts the rows of each bucket of the range, and the bucket with
    the rank, from its least to its largest value, is the next range, until
    there is one value in it. A pass is an aggregate of at most ``buckets``
    numbers for each rank; a row for each rank goes to the driver. Null and NaN
    are no values; a group without any has no row. Values must be finite.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares are from 0 to 1")
    spark, keys = df.sparkSession, [f"__q{i}" for i in range(len(by))]
    kinds = [StructField(k, df.schema[c].dataType) for k, c in zip(keys, by, strict=True)]
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), v.alias("v")).where("v is not null and not isnan(v)").persist()
    try:
        found = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0").collect()
        groups = [tuple(r[k] for k in keys) for r in found]
        wanted = {(g, k): [r["lo"], r["hi"], 0] for g, r in enumerate(found) for s in shares for k in (math.floor(s * (r["n"] - 1)), math.ceil(s * (r["n"] - 1)))}
        if any(math.isinf(x) for r in found for x in (r["lo"], r["hi"])):
            raise ValueError("values must be finite")
        told = StructType([*(StructField(f"{f.name}_", f.dataType) for f in kinds), StructField("g", IntegerType()), StructField("k", LongType()), StructField("lo", DoubleType()), StructField("hi", DoubleType()), StructField("below", LongType())])
        while open_ := {at: x for at, x in wanted.items() if x[0] < x[1]}:
            ranks = spark.createDataFrame([(*groups[g], g, k, lo, hi, below) for (g, k), (lo, hi, below) in open_.items()], told)
            met = rows.join(F.broadcast(ranks), same(keys) & F.col("v").between(F.col("lo"), F.col("hi")))  # a row for each rank
            # halves, as the range of two finite values may not be finite
            place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))
            cells = met.groupBy("g", "k", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("below").alias("below"))
            upto = F.sum("n").over(Window.partitionBy("g", "k").orderBy("place"))
            for r in cells.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))).collect():
                wanted[r["g"], r["k"]] = [r["least"], r["most"], r["upto"] - r["n"]]
    finally:
        rows.unpersist()
    out = []
    for g, r in enumerate(found):
        for s in shares:
            at = s * (r["n"] - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = wanted[g, low][0], wanted[g, high][0]
            out.append((*groups[g], float(s), a if a == b else (high - at) * a + (at - low) * b))
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(by, kinds, strict=True)), StructField("share", DoubleType()), StructField("q", DoubleType())])
    return spark.createDataFrame(out, schema)
