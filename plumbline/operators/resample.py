"""Bootstraps, null simulations and permutations by weights that each row draws for itself.

A sample is folded into units: rows of a group with the same price and outcome
(and the same cluster, if clusters are drawn) are one, with their number. In
each replicate a unit counts a Poisson number of times; where clusters are drawn
the cluster's number holds for all its units. The numbers come from a
counter-based generator whose key is the seed and the unit (or cluster), so
they are the same wherever and in whatever order units are met, and no sample
travels: a task makes the weights of the units that it reads and hands on a few
sums for each replicate. What comes to the driver is a row for each group and
replicate, whatever the size of the sample.

The number of rows of a replicate so varies by about its square root around
that of the sample; rates, slopes and gaps are those of the rows drawn.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from plumbline.functions.scalars import logit
from plumbline.operators.cox import CLIP, STEPS, TOLERANCE

#: Share of replicates without a fit above which a result is refused.
FAILURES = 0.01
#: Units whose weights a task holds at a time.
HELD_UNITS = 256
#: Nodes that stand for the units of a cell of logits, its width, and the slope up to which their interpolation (4 e-9 there) is trusted.
NODES, CELL, TRUSTED = 16, 0.5, 8.0
#: Replicates that a task fits at a time, and bytes of sums that a task holds.
BLOCK, HELD_BYTES = 250, 64 << 20
#: Ranges of prices for bins of equal counts, at least.
RANGES = 8


def replicate(spark: SparkSession, reps: int, seed: int, statistic: Callable[[np.random.Generator], dict[str, float]], names: Sequence[str]) -> DataFrame:
    """``rep`` and the named statistics of each replicate, for statistics of a few numbers that travel with the tasks."""
    schema = "rep long, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rep in batch["id"]:
                rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(int(rep),)))
                rows.append({"rep": int(rep)} | {k: float(v) for k, v in statistic(rng).items()})
            yield pd.DataFrame(rows, columns=["rep", *names])

    tasks = max(1, min(reps, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, reps, 1, tasks).mapInPandas(run, schema)


def intervals(replicates: DataFrame, names: Sequence[str], alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """By group: name, lo, hi, mean, failures and reps. NaN replicates count as failures, and too many are refused."""
    each = replicates.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("__v")) for n in names))))
    value = F.when(~F.isnan("__v"), F.col("__v"))
    out = each.groupBy(*by, "name").agg(F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"), F.avg(value).alias("mean"), (F.count(F.lit(1)) - F.count(value)).alias("failures"), F.count(F.lit(1)).alias("reps"))
    refused = F.when(F.col("failures") > FAILURES * F.col("reps"), F.raise_error(F.lit("too many replicates have no fit")).cast("double")).otherwise(F.col("lo"))
    return out.withColumn("lo", refused)


def weights(keys: np.ndarray, rates: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """How often each unit (row) counts in each replicate (column): Poisson numbers of its rate, drawn by its own key."""
    out, last = np.empty((len(keys), reps)), None
    for i, unit in enumerate(zip(keys.astype(np.int64).view(np.uint64).tolist(), rates.tolist(), strict=True)):
        key, rate = unit
        out[i] = out[i - 1] if unit == last else np.random.Generator(np.random.Philox(key=np.array([seed, key], np.uint64))).poisson(rate, reps)
        last = unit
    return out


class Units:
    """A sample folded into units, with its groups numbered; ``close`` gives up what is held of it."""

    def __init__(self, df: DataFrame, by: Sequence[str], reps: int, seed: int, cluster: Sequence[str] = (), rate: Column | None = None, p: str = "p", y: str = "y"):
        """``rate``: how often a row counts on the average, instead of once; such rows aren't clusters'."""
        if reps < 1:
            raise ValueError("no replicates")
        self.spark, self.by, self.reps, self.seed = df.sparkSession, list(by), reps, seed
        rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*(F.col(c).alias(f"__b{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(cluster)), F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y"), (F.lit(1.0) if rate is None else rate.cast("double")).alias("rate"))
        groups, clusters = [f"__b{i}" for i in range(len(by))], [f"__c{i}" for i in range(len(cluster))]
        told = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (clusters or [*groups, "p", "y"])]
        folded = rows.groupBy(*groups, *clusters, "p", "y").agg(F.sum("rate").alias("rate"))
        drawn, times = (F.lit(1.0), F.col("rate")) if clusters else (F.col("rate"), F.lit(1.0))
        own = folded.select(*groups, F.xxhash64(*told).alias("key"), "p", "y", logit("p", CLIP).alias("x"), drawn.alias("rate"), times.alias("times"))
        # few bytes, but much work: dealt to a given number of tasks, units of one cluster or cell side by side
        tasks, salt = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), F.pmod(F.xxhash64("p"), F.lit(4))
        own = own.repartition(tasks, "key", salt).sortWithinPartitions("key") if clusters else own.repartition(tasks, *groups, F.floor(F.col("x") / CELL), salt).sortWithinPartitions(*groups, "p")
        own = own.persist()
        self.held = [own]
        schema = StructType()
        for i, c in enumerate(by):
            schema = schema.add(f"__b{i}", df.schema[c].dataType)
        self.kind = StructType([df.schema[c] for c in by])
        self.groups = sorted((tuple(r) for r in own.select(*groups).distinct().collect()), key=lambda g: [(v is not None, v) for v in g]) if by else [()] * (not own.isEmpty())
        if not self.groups:
            raise ValueError("no rows")
        if by:
            told = self.spark.createDataFrame([(*g, i) for i, g in enumerate(self.groups)], schema.add("g", "integer")).withColumnsRenamed({c: f"{c}_" for c in groups})
            same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in groups))
            own = own.join(F.broadcast(told), same)  # a row for each group
        else:
            own = own.withColumn("g", F.lit(0))
        self.rows = own.select("g", "key", "p", "y", "x", "rate", "times")
        on = lambda mask: F.when(mask, F.col("x"))
        won, lost, one = F.col("y") == 1, F.col("y") != 1, F.lit(1.0)
        added = {"n": F.col("times"), "won": F.col("times") * F.col("y"), "loss2": F.col("times") * F.pow(F.col("p") - F.col("y"), 2), "won_x": F.col("times") * F.col("x") * F.col("y")}
        ends = {"won_lo": (F.min, on(won)), "won_hi": (F.max, on(won)), "lost_lo": (F.min, on(lost)), "lost_hi": (F.max, on(lost))}
        self.nodes = None
        if not clusters:  # a unit is drawn by itself
            self.shapes = self.rows.select("g", "key", "rate", one.alias("times"), *(v.alias(c) for c, v in added.items()), *(v.alias(c) for c, (_, v) in ends.items()))
            return
        # all that a cluster's units add is drawn together, so it is summed before it is drawn
        self.shapes = self.rows.groupBy("g", "key").agg(*(F.sum(v).alias(c) for c, v in added.items()), *(f(v).alias(c) for c, (f, v) in ends.items())).withColumns({"rate": one, "times": one})
        names = [f"n{i}" for i in range(NODES)]
        parts = self.rows.select("g", "key", "x", "times").mapInArrow(_node_sums, "g int, key long, cell int, " + ", ".join(f"{c} double" for c in names))
        self.nodes = parts.repartition(tasks, "key").groupBy("g", "key", "cell").agg(*(F.sum(c).alias(c) for c in names)).sortWithinPartitions("key").withColumns({"rate": one, "times": one})

    def close(self) -> None:
        for df in self.held:
            df.unpersist()

    def __enter__(self) -> Units:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def frame(self, columns: dict[str, np.ndarray]) -> DataFrame:
        """The group, ``rep`` and statistics of every group and replicate; arrays are (groups, replicates)."""
        rows = [(*g, r, *(float(v[i, r]) for v in columns.values())) for i, g in enumerate(self.groups) for r in range(self.reps)]
        schema = functools.reduce(lambda s, c: s.add(c, DoubleType()), columns, StructType([*self.kind.fields]).add("rep", LongType()))
        return self.spark.createDataFrame(rows, schema)


def _node_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By group, cluster and cell, how much a batch's units count at the cell's nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g, key, x, times = (batch[c].to_numpy(zero_copy_only=False) for c in ("g", "key", "x", "times"))
        cell = np.floor(x / CELL).astype(np.int32)
        order = np.lexsort((cell, key, g))
        g, key, cell = g[order], key[order], cell[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        sums = np.add.reduceat(at_nodes(x[order], cell) * times[order][:, None], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(key[first]), pa.array(cell[first]), *(pa.array(np.ascontiguousarray(v)) for v in sums.T)], names=["g", "key", "cell", *(f"n{i}" for i in range(NODES))])


def _weighted(batch: pa.RecordBatch | pa.Table, reps: int, seed: int, some: np.ndarray | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and weights of a few units at a time, of ``some`` of the replicates."""
    for at in range(0, batch.num_rows, HELD_UNITS):
        part = batch.slice(at, HELD_UNITS)
        columns = {n: part[n].to_numpy() if isinstance(part, pa.Table) else part[n].to_numpy(zero_copy_only=False) for n in part.schema.names}
        w = weights(columns["key"], columns["rate"], reps, seed) * columns["times"][:, None]
        yield columns, w if some is None else w[:, some]


def _sums(units: Units, rows: DataFrame, of: Callable[[int, dict[str, np.ndarray], np.ndarray], np.ndarray], names: Sequence[str], how: Sequence[Callable[[str], Column]]) -> np.ndarray:
    """(statistic, group, replicate) of what ``of`` makes of a group's units, or of sums of them: an array (statistic, replicate) each, reduced in the tasks and then by ``how``."""
    groups, reps, seed = len(units.groups), units.reps, units.seed
    numpy_how = [{"sum": np.add, "min": np.fmin, "max": np.fmax}[h.__name__] for h in how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for columns, w in _weighted(batch, reps, seed):
                for g in np.unique(columns["g"]).tolist():
                    at = columns["g"] == g
                    new = of(g, {n: v[at] for n, v in columns.items()}, w[at])
                    found[g] = new if g not in found else np.stack([f(a, b) for f, a, b in zip(numpy_how, found[g], new, strict=True)])
        for g, values in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(reps, g, np.int32)), pa.array(np.arange(reps)), *(pa.array(v, from_pandas=True) for v in values)], names=["g", "rep", *names])

    schema = "g int, rep long, " + ", ".join(f"{n} double" for n in names)
    rows = rows.mapInArrow(run, schema).groupBy("g", "rep").agg(*(h(n).alias(n) for h, n in zip(how, names, strict=True))).toArrow()  # a row for each group and replicate
    out = np.full((len(names), groups, reps), np.nan)
    out[:, rows["g"].to_numpy(), rows["rep"].to_numpy()] = [rows[c].to_numpy() for c in names]
    return out


_SHAPE = {"n": F.sum, "won": F.sum, "loss2": F.sum, "won_lo": F.min, "won_hi": F.max, "lost_lo": F.min, "lost_hi": F.max, "won_x": F.sum}


def _shape(_: int, c: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
    """Weight, weight of wins, weighted squared error, the ranges of x where won and where lost, and x summed where won."""
    met = w > 0
    finite = lambda v: np.where(np.isfinite(v), v, np.nan)
    edge = lambda x, f, empty: finite(f(np.where(met & ~np.isnan(x)[:, None], x[:, None], empty), axis=0))
    low, high = (lambda name: edge(c[name], np.min, np.inf)), (lambda name: edge(c[name], np.max, -np.inf))
    return np.stack([c["n"] @ w, c["won"] @ w, c["loss2"] @ w, low("won_lo"), high("won_hi"), low("lost_lo"), high("lost_hi"), c["won_x"] @ w])


def shape_of(units: Units) -> dict[str, np.ndarray]:
    return dict(zip(_SHAPE, _sums(units, units.shapes, _shape, list(_SHAPE), list(_SHAPE.values())), strict=True))


_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASIS = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES), 2.0, 1.0)[:, None] / NODES


def at_nodes(x: np.ndarray, cell: int | np.ndarray) -> np.ndarray:
    """(unit, node): the shares by which a unit of a cell counts at the cell's Chebyshev nodes, so that sums of smooth functions of x stay."""
    return np.polynomial.chebyshev.chebvander(2 * (x / CELL - cell) - 1, NODES - 1) @ _BASIS


def _newton(x: np.ndarray, w: np.ndarray, n: np.ndarray, won: np.ndarray, won_x: np.ndarray, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and whether it is met, for the columns (replicates) of the weights of points x; halved where the loss rises."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = np.where(sound, np.log(won / (n - won)), 0.0), np.zeros(len(n))
    open_, done = sound.copy(), np.zeros(len(n), bool)
    a0, b0, best = a.copy(), b.copy(), np.full(len(n), np.inf)
    for _ in range(2 * STEPS):
        on = np.flatnonzero(open_)
        if not len(on):
            break
        eta, v = a[on] + x[:, None] * b[on], w[:, on]
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        r, h = v * mu, v * mu * (1 - mu)
        g0, g1, h0, h1, h2 = r.sum(0) - won[on], x @ r - won_x[on], h.sum(0), x @ h, (x * x) @ h
        loss = (v * np.logaddexp(0.0, eta)).sum(0) - a[on] * won[on] - b[on] * won_x[on]
        worse = ~(loss <= best[on] + 1e-12 * np.abs(best[on]))
        bad, fine = on[worse], on[~worse]
        a[bad], b[bad] = (a0[bad] + a[bad]) / 2, (b0[bad] + b[bad]) / 2
        open_[bad[np.maximum(abs(a - a0), abs(b - b0))[bad] < 1e-12]] = False
        a0[fine], b0[fine], best[fine] = a[fine], b[fine], loss[~worse]
        g0, g1, h0, h1, h2 = (s[~worse] for s in (g0, g1, h0, h1, h2))
        met = np.maximum(abs(g0), abs(g1)) < TOLERANCE * np.maximum(1.0, np.sqrt(n[fine]))
        det = h0 * h2 - h1 * h1
        lost = ~met & ((det <= 1e-12 * np.maximum(1.0, h0 * h2)) | (np.maximum(abs(a), abs(b))[fine] > 1e4))
        done[fine[met]], open_[fine[met | lost]] = True, False
        go = ~(met | lost)
        at, g0, g1, h0, h1, h2, det = (s[go] for s in (fine, g0, g1, h0, h1, h2, det))
        a[at], b[at] = a[at] - (h2 * g0 - h1 * g1) / det, b[at] - (h0 * g1 - h1 * g0) / det
    return b0, a0, done


def _by_nodes(units: Units, shape: dict[str, np.ndarray], sound: np.ndarray) -> np.ndarray:
    """(slope, intercept, trusted) by group and replicate, from one pass over the units.

    Units of a cell of logits count at the cell's nodes, whatever their number,
    and a task takes all Newton steps of some replicates over the nodes. Steep
    fits, for which the nodes are too far apart, aren't trusted.
    """
    reps, seed, summed = units.reps, units.seed, units.nodes is not None
    told = {c: shape[c] for c in ("n", "won", "won_x")}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (g, cell), sums in held.items():
                blocks = [np.ascontiguousarray(sums[:, i : i + BLOCK]).tobytes() for i in range(0, reps, BLOCK)]
                k = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, g, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, cell, np.int32)), pa.array(blocks, pa.binary())], names=["g", "block", "cell", "sums"])
            held.clear()

        for batch in batches:
            for c, w in _weighted(batch, reps, seed):
                cells = (c["cell"] if summed else np.floor(c["x"] / CELL)).astype(np.int64)
                for g, cell in np.unique(np.column_stack([c["g"], cells]), axis=0).tolist():
                    at = (c["g"] == g) & (cells == cell)
                    shares = np.column_stack([c[f"n{i}"][at] for i in range(NODES)]) if summed else at_nodes(c["x"][at], cell)
                    sums = shares.T @ w[at]
                    held[g, cell] = held[g, cell] + sums if (g, cell) in held else sums
                if len(held) * NODES * reps * 8 > HELD_BYTES:
                    yield from flush()
        yield from flush()

    def solve(rows: pa.Table) -> pa.Table:
        g, block = rows["g"][0].as_py(), rows["block"][0].as_py()
        sums: dict[int, np.ndarray] = {}
        for cell, part in zip(rows["cell"].to_pylist(), rows["sums"], strict=True):
            own = np.frombuffer(part.as_buffer()).reshape(NODES, -1)
            sums[cell] = sums[cell] + own if cell in sums else own
        cells = sorted(sums)
        x, w = np.concatenate([(c + (_AT + 1) / 2) * CELL for c in cells]), np.concatenate([sums[c] for c in cells])
        some = slice(block * BLOCK, block * BLOCK + w.shape[1])
        slope, intercept, met = _newton(x, w, *(told[c][g, some] for c in ("n", "won", "won_x")), sound[g, some])
        k = w.shape[1]
        return pa.table({"g": np.full(k, g, np.int32), "rep": np.arange(k) + block * BLOCK, "slope": slope, "intercept": intercept, "trusted": (met & (np.abs(slope) <= TRUSTED)).astype(float)})

    parts = (units.rows if units.nodes is None else units.nodes).mapInArrow(gather, "g int, block int, cell int, sums binary")
    rows = parts.groupBy("g", "block").applyInArrow(solve, "g int, rep long, slope double, intercept double, trusted double").toArrow()  # a row for each group and replicate
    out = np.zeros((3, len(units.groups), reps))
    out[:, rows["g"].to_numpy(), rows["rep"].to_numpy()] = [rows[c].to_numpy() for c in ("slope", "intercept", "trusted")]
    return out


def fits(units: Units, shape: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of each group and replicate; NaN where the rows drawn don't determine a fit.

    Replicates are fitted over nodes, by one pass. The few whose fit is too
    steep for that take their Newton steps together over the units: a step is
    one aggregate of six sums for each, halved where the loss rises.
    """
    n, won = shape["n"], shape["won"]
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = won / n
        span = np.fmax(shape["won_hi"], shape["lost_hi"]) - np.fmin(shape["won_lo"], shape["lost_lo"])
        sound = (n > 0) & (rate > 0) & (rate < 1) & (span >= 1e-9) & (shape["won_lo"] < shape["lost_hi"]) & (shape["lost_lo"] < shape["won_hi"])
        a, b = np.where(sound, np.log(rate / (1 - rate)), np.nan), np.where(sound, 0.0, np.nan)
    b_nodes, a_nodes, trusted = _by_nodes(units, shape, sound) if sound.any() else np.zeros((3, *sound.shape))
    done = sound & (trusted > 0)
    open_ = sound & ~done
    a, b = np.where(done, a_nodes, a), np.where(done, b_nodes, b)
    a0, b0, best = a.copy(), b.copy(), np.full(a.shape, np.inf)
    for _ in range(2 * STEPS):
        if not open_.any():
            break
        now_a, now_b, on = a.copy(), b.copy(), open_.copy()

        def step(g: int, c: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
            some = np.flatnonzero(on[g])
            out = np.full((6, w.shape[1]), 0.0)
            if len(some):
                x, y, w = c["x"], c["y"], w[:, some]
                eta = now_a[g, some] + x[:, None] * now_b[g, some]
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                r, v = w * (mu - y[:, None]), w * mu * (1 - mu)
                loss = w * (np.logaddexp(0.0, eta) - y[:, None] * eta)
                out[:, some] = r.sum(0), x @ r, v.sum(0), x @ v, (x * x) @ v, loss.sum(0)
            return out

        g0, g1, h0, h1, h2, loss = _sums(units, units.rows, step, [f"s{i}" for i in range(6)], [F.sum] * 6)
        worse = on & ~(loss <= best * (1 + 1e-12))
        a, b = np.where(worse, (a0 + a) / 2, a), np.where(worse, (b0 + b) / 2, b)
        open_ &= ~(worse & (np.maximum(abs(a - a0), abs(b - b0)) < 1e-12))
        fine = on & ~worse
        a0, b0, best = np.where(fine, a, a0), np.where(fine, b, b0), np.where(fine, loss, best)
        met = fine & (np.maximum(abs(g0), abs(g1)) < TOLERANCE * np.maximum(1.0, np.sqrt(n)))
        done |= met
        det = h0 * h2 - h1 * h1
        lost = fine & ~met & ((det <= 1e-12 * np.maximum(1.0, h0 * h2)) | (np.maximum(abs(a), abs(b)) > 1e4))
        open_ &= ~(met | lost)
        with np.errstate(invalid="ignore", divide="ignore"):
            go = open_ & fine
            a, b = np.where(go, a - (h2 * g0 - h1 * g1) / det, a), np.where(go, b - (h0 * g1 - h1 * g0) / det, b)
    return np.where(done, b0, np.nan), np.where(done, a0, np.nan)


def bin_gaps(units: Units, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """ECE and largest gap of bins of equal counts, by group and replicate.

    Prices are dealt into ranges; the weights of the ranges before a range say
    where its units stand in each replicate. Units of one price share what a
    bin's edge cuts off them in proportion, as rows in random order do on the
    average. Not for drawn clusters, whose units of one price may be many.
    """
    spark, reps, seed = units.spark, units.reps, units.seed
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(units.rows.agg(F.percentile_approx("p", [i / ranges for i in range(1, ranges)], F.lit(20 * ranges))).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("p"))) if edges else F.lit(0)
    rows = units.rows.withColumn("part", place)

    def total(rows: pa.Table) -> pa.Table:
        sums = sum(w.sum(0) for _, w in _weighted(rows, reps, seed))
        return pa.table({"g": rows["g"][:1], "part": rows["part"][:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    def before(rows: pa.Table) -> pa.Table:
        """For each range of a group the weight of the ranges before it, and of all."""
        rows = rows.sort_by("part")
        sums = np.stack([np.frombuffer(x) for x in rows["sums"].to_pylist()])
        upto, n = np.cumsum(sums, axis=0), sums.sum(axis=0).tobytes()
        return pa.table({"g": rows["g"], "part": rows["part"], "before": pa.array([(u - own).tobytes() for u, own in zip(upto, sums, strict=True)], pa.binary()), "n": pa.array([n] * len(sums), pa.binary())})

    def share(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("p")
        upto, n = (np.frombuffer(told[c][0].as_py()) for c in ("before", "n"))
        cuts, out = np.floor(n * np.arange(bins + 1)[:, None] / bins), np.zeros((bins, 3, reps))
        prices = rows["p"].to_numpy()
        starts = np.append(np.flatnonzero(np.concatenate([[True], prices[1:] != prices[:-1]])), len(prices))
        at = 0
        while at < len(starts) - 1:  # whole prices only, a few at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + HELD_UNITS, side="right")) - 1)
            parts = list(_weighted(rows.slice(starts[at], starts[to] - starts[at]), reps, seed))
            w, y = np.concatenate([w for _, w in parts]), np.concatenate([c["y"] for c, _ in parts])
            first = starts[at:to] - starts[at]
            size, won = np.add.reduceat(w, first), np.add.reduceat(w * y[:, None], first)
            ends, rate = upto + np.cumsum(size, axis=0), np.divide(won, size, out=np.zeros_like(won), where=size > 0)
            for k in range(bins):
                inside = np.maximum(np.minimum(ends, cuts[k + 1]) - np.maximum(ends - size, cuts[k]), 0.0)
                out[k] += inside.sum(0), prices[starts[at:to]] @ inside, (rate * inside).sum(0)
            at, upto = to, ends[-1]
        k, r = np.divmod(np.arange(bins * reps), reps)
        return pa.table({"g": np.full(len(k), rows["g"][0].as_py(), np.int32), "rep": r, "bin": k.astype(np.int32), **{name: out[:, i].ravel() for i, name in enumerate(("n", "p", "won"))}})

    told = rows.groupBy("g", "part").applyInArrow(total, "g int, part int, sums binary").groupBy("g").applyInArrow(before, "g int, part int, before binary, n binary")
    parts = rows.groupBy("g", "part").cogroup(told.groupBy("g", "part")).applyInArrow(share, "g int, rep long, bin int, n double, p double, won double")
    sums = parts.groupBy("g", "rep", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "p", "won"))).where("n > 0")
    gap = F.abs(F.col("p") - F.col("won"))
    found = sums.groupBy("g", "rep").agg((F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("worst")).toArrow()
    out = np.full((2, len(units.groups), reps), np.nan)
    out[:, found["g"].to_numpy(), found["rep"].to_numpy()] = [found[c].to_numpy() for c in ("ece", "worst")]
    return out[0], out[1]


def bootstrap_scalars(df: DataFrame, reps: int = 2000, seed: int = 0, bins: int = 10, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """By group, replicates of ECE, Brier score, slope and intercept over resampled rows. Rows without a price or outcome take no part; none at all is an error."""
    with Units(df, by, reps, seed, p=p, y=y) as units:
        shape = shape_of(units)
        slope, intercept = fits(units, shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            return units.frame({"ece": bin_gaps(units, bins)[0], "brier": shape["loss2"] / shape["n"], "slope": slope, "intercept": intercept})


def bootstrap_curve(df: DataFrame, edges: Sequence[float], reps: int = 2000, seed: int = 0, alpha: float = 0.05, p: str = "p", y: str = "y") -> DataFrame:
    """Bands of the observed rate in bins by fixed edges; a bin that a replicate leaves empty is none of its rows."""
    place = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col(p)))
    with Units(df.withColumn("bin", place), ["bin"], reps, seed, p=p, y=y) as units:
        shape = shape_of(units)
        with np.errstate(invalid="ignore", divide="ignore"):
            rates = units.frame({"rate": shape["won"] / shape["n"]}).where("not isnan(rate)")
    return rates.groupBy("bin").agg(F.percentile("rate", alpha / 2).alias("lo"), F.percentile("rate", 1 - alpha / 2).alias("hi"))


def simulate_nulls(df: DataFrame, sizes: Sequence[tuple[str, int]], pool: str = "sport", whole: str = "all", reps: int = 4000, bins: int = 10, seed: int = 7, p: str = "p") -> DataFrame:
    """Replicates of the statistics if prices were true, for each (pool, n) of ``sizes``: n prices of the pool on the average, outcomes drawn from them.

    A pool is a value of the column ``pool``, and ``whole`` is all rows. A price
    is drawn a Poisson number of times with either outcome, each in proportion
    to its chance. A pool without rows is an error.
    """
    prices = df.where(F.col(p).isNotNull()).groupBy(F.col(pool).cast("string").alias("pool"), F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("m"))
    counts = {r["pool"]: r["n"] for r in prices.groupBy("pool").agg(F.sum("m").alias("n")).collect()}
    counts[whole] = sum(counts.values())
    if absent := [name for name, _ in sizes if not counts.get(name)]:
        raise ValueError(f"no rows of {absent}")
    told = df.sparkSession.createDataFrame([(name, int(n), n / counts[name]) for name, n in sizes], "__pool string, n long, share double")
    met = prices.join(F.broadcast(told), (F.col("pool") == F.col("__pool")) | (F.col("__pool") == whole))  # a row for each size
    rate = F.col("share") * F.col("m") * F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    rows = met.select(F.col("__pool").alias("pool"), "n", "p", "m", "share", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("y"))
    with Units(rows, ["pool", "n"], reps, seed, rate=rate) as units:
        slope, intercept = fits(units, shape_of(units))
        ece, worst = bin_gaps(units, bins)
        return units.frame({"ece": ece, "max_bin_dev": worst, "slope": slope, "intercept": intercept})


def simulate_null(df: DataFrame, n: int, reps: int = 4000, bins: int = 10, seed: int = 7, p: str = "p") -> DataFrame:
    """``simulate_nulls`` of one size, from all rows."""
    return simulate_nulls(df.withColumn("__all", F.lit("")), [("all", n)], "__all", "all", reps, bins, seed, p).drop("pool", "n")


def _difference(df: DataFrame, by: Sequence[str], level: str, low: str, high: str, reps: int, seed: int, p: str, y: str, cluster: Sequence[str] = ()) -> DataFrame:
    """By group and replicate, slope(low) - slope(high): null where a stratum is absent, NaN where one has no fit."""
    with Units(df.where(F.col(level).isin(low, high)), [*by, level], reps, seed, cluster, p=p, y=y) as units:
        slopes = units.frame({"slope": fits(units, shape_of(units))[0]})
    of = lambda k: F.max(F.when(F.col(level) == k, F.col("slope")))
    return slopes.groupBy(*by, "rep").agg((of(low) - of(high)).alias("difference"))


def slope_difference(low: DataFrame, high: DataFrame, reps: int = 4000, seed: int = 0, p: str = "p", y: str = "y") -> DataFrame:
    """Replicates of slope(low) - slope(high), each stratum resampled by itself."""
    both = low.select(F.lit("low").alias("__s"), p, y).unionByName(high.select(F.lit("high").alias("__s"), p, y))
    return _difference(both, [], "__s", "low", "high", reps, seed, p, y)


def slope_differences(df: DataFrame, by: str, level: str, low: str, high: str, reps: int = 4000, seed: int = 0, p: str = "p", y: str = "y") -> DataFrame:
    """``slope_difference`` of every group at once: ``by``, rep and difference. A group that lacks a stratum has nulls."""
    return _difference(df, [by], level, low, high, reps, seed, p, y)


def achieved_level(replicates: DataFrame, observed: float, name: str = "difference") -> DataFrame:
    """``asl``: the share of replicates that don't have the sign of the observed value; ``asl_floor``: the least share that so many can tell."""
    sound = F.when(~F.isnan(name), F.col(name))
    other = sound <= 0 if observed > 0 else sound >= 0
    return replicates.agg((F.count(F.when(other, 1)) / F.count(sound)).alias("asl"), (1 / F.count(F.lit(1))).alias("asl_floor"))


def cluster_slope_difference(df: DataFrame, level: str, cluster: str, low: str, high: str, reps: int = 4000, seed: int = 0, p: str = "p", y: str = "y") -> DataFrame:
    """As ``slope_difference``, but whole clusters are drawn, with all their rows of both strata."""
    return _difference(df, [], level, low, high, reps, seed, p, y, [cluster])


def stationary_blocks(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Places of n dates drawn in runs of geometric length, around the end to the beginning."""
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    start = rng.integers(0, n, n)
    run = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (start[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))] + run) % n


def daily_sums(df: DataFrame, value: str, date: str) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of a value's rows on each date, in order: two numbers a date, which travel with the tasks that draw dates."""
    days = df.where(F.col(value).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(date).cast("string").alias("d")).agg(F.sum(value).alias("s"), F.count(value).cast("double").alias("n")).orderBy("d").toPandas()
    if not len(days):
        raise ValueError("no rows")
    return days["s"].to_numpy(float), days["n"].to_numpy(float)


def stationary_mean(df: DataFrame, value: str, date: str, reps: int = 2000, seed: int = 0, mean_block: float = 5.0) -> DataFrame:
    """Replicates of a mean over rows whose dates are drawn in runs."""
    s, n = daily_sums(df, value, date)

    def one(rng: np.random.Generator) -> dict[str, float]:
        at = stationary_blocks(len(s), mean_block, rng)
        return {"mean": s[at].sum() / n[at].sum()}

    return replicate(df.sparkSession, reps, seed, one, ["mean"])


def dated_means(df: DataFrame, value: str, date: str, by: Sequence[str], reps: int = 2000, seed: int = 0, times: str | None = None) -> DataFrame:
    """By group and replicate, the mean over rows whose dates are drawn one by one: ``by``, rep and mean. Two numbers for each group and date travel.

    With ``times``, a row is the sum of so many.
    """
    days = df.where(F.col(value).isNotNull() & F.col(date).isNotNull()).groupBy(*by, F.col(date).cast("string").alias("__d")).agg(F.sum(value).alias("__s"), (F.count(value) if times is None else F.sum(times)).alias("__n")).orderBy(*by, "__d").collect()
    groups: dict[tuple, list[tuple[float, float]]] = {}
    for r in days:
        groups.setdefault(tuple(r[c] for c in by), []).append((float(r["__s"]), float(r["__n"])))
    names, own = [f"g{i}" for i in range(len(groups))], [np.array(v) for v in groups.values()]
    if not names:
        raise ValueError("no rows")

    def one(rng: np.random.Generator) -> dict[str, float]:
        sums = [v[rng.integers(0, len(v), len(v))].sum(axis=0) for v in own]
        return {g: s / n for g, (s, n) in zip(names, sums, strict=True)}

    each = F.array(*(F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(by, key, strict=True)), F.col(g).alias("mean")) for g, key in zip(names, groups, strict=True)))
    return replicate(df.sparkSession, reps, seed, one, names).select("rep", F.inline(each))


def shuffled_agreement(df: DataFrame, market: str, league: str, draws: int = 20, seed: int = 20260912) -> DataFrame:
    """By draw: how often the market's winners, dealt out at random, agree with the league's, and how often by chance.

    How many agree hangs on the numbers of each winner alone, so those are all that is drawn from.
    """
    found = df.where(F.col(market).isNotNull() & F.col(league).isNotNull()).groupBy(F.col(market).alias("m"), F.col(league).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        raise ValueError("no rows")
    names = sorted({r[c] for r in found for c in ("m", "l")})
    ours, theirs = (np.array([sum(r["n"] for r in found if r[c] == k) for k in names]) for c in ("m", "l"))
    total = int(ours.sum())
    home = theirs[names.index("home")] / total if "home" in names else 0.0

    def one(rng: np.random.Generator) -> dict[str, float]:
        left, same = ours.copy(), 0
        for k, size in enumerate(theirs):  # the winners dealt to the games that this one has won
            dealt = rng.multivariate_hypergeometric(left, int(size))
            left, same = left - dealt, same + int(dealt[k])
        return {"agreement": same / total, "chance": home**2 + (1 - home) ** 2}

    return replicate(df.sparkSession, draws, seed, one, ["agreement", "chance"])


def hit_rate(df: DataFrame, hit: str, by: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """By group and replicate, the mean of a 0/1 column: n draws of n rows are a binomial count, so no row travels."""
    counts = [(r[by], r["n"], r["k"]) for r in df.where(F.col(hit).isNotNull()).groupBy(by).agg(F.count(hit).alias("n"), F.sum(hit).alias("k")).orderBy(by).collect()]
    names = [f"g{i}" for i in range(len(counts))]
    if not names:
        raise ValueError("no rows")
    rows = replicate(df.sparkSession, reps, seed, lambda rng: {g: rng.binomial(n, k / n) / n for g, (_, n, k) in zip(names, counts, strict=True)}, names)
    return rows.select("rep", F.inline(F.array(*(F.struct(F.lit(key).alias(by), F.col(g).alias("rate")) for g, (key, _, _) in zip(names, counts, strict=True)))))
