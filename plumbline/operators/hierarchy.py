"""Fits of the hierarchical model by task, from designs in the shared folder: whole tables, and rolling origins.

A design is a table of games with the group (``g``, a number from 0) whose fit
they belong to and their role in it. It is written by group, cell by cell; a
task samples one chain of one group from the group's training rows, or, where
these are many, from sums over its cells that all tasks have made. Draws are
written by group too, and forecasts are made where the games are: each task
meets the draws of a group at a time. Nothing but names of teams, modes and
diagnostics comes to the driver.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import model as M
from plumbline.operators.scores import score_set
from plumbline.sources.scratch import dropped, opened, shared_folder
from plumbline.sources.scratch import kept as written

#: Columns of a design besides what a caller adds.
DESIGN = ("g", "role", "season", "game_id", "home", "away", "neutral", "y", "rating", "x")
#: Draws and games that are read at a time, and chances that are taken at a time.
BLOCK_DRAWS, BLOCK_GAMES, BLOCK_CHANCES = 250, 1 << 16, 1 << 16
#: Rows of a group above which all tasks sum its cells, and above which no chain holds them; passes that lead to a mode.
SUMMED_ROWS, HELD_ROWS, MODE_STEPS = 1 << 18, 1 << 21, 20


class Fits(NamedTuple):
    """Where design and draws of some groups are, and the team-seasons that each has seen."""

    design: str
    draws: str
    names: dict[int, list[str]]


def _files(path: str, g: int) -> list[str]:
    """A group's files, by name."""
    from pyarrow.fs import FileSelector

    store, root = opened(f"{path}/g={g}")
    return sorted(f.path for f in store.get_file_info(FileSelector(root)) if f.path.endswith(".parquet"))


def _read(path: str, g: int, columns: Sequence[str], role: str | None = None, files: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of a group's files, or of some of them, file after file; nothing is read ahead."""
    import pyarrow.parquet as pq

    store, _ = opened(path)
    for name in _files(path, g) if files is None else files:
        with store.open_input_file(name) as source:
            more = [] if role is None else ["role"]
            for batch in pq.ParquetFile(source).iter_batches(BLOCK_DRAWS if role is None else BLOCK_GAMES, columns=[*columns, *more], use_threads=False):
                batch = batch if role is None else batch.filter(pc.equal(batch["role"], role))
                yield batch.select(list(columns))


def _parts(path: str, g: int, names: Sequence[str], files: Sequence[str] | None = None) -> Iterator[M.Data]:
    """The training rows of a group as they come."""
    known = pa.array(names, pa.string())
    for batch in _read(path, g, ["home", "away", "neutral", "y", "rating", "x"], "train", files):
        if batch.num_rows:
            rating, neutral, y = (batch[c].to_numpy(zero_copy_only=False) for c in ("rating", "neutral", "y"))
            home, away = (pc.index_in(batch[c], known).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("home", "away"))
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield M.Data(x, rating, home, away, neutral, y, len(names))


def training_data(path: str, g: int, names: Sequence[str]) -> M.Data:
    """The training rows of a group as arrays, in canonical order; they are put there batch by batch."""
    keys = pa.Table.from_batches(list(_read(path, g, ["season", "game_id"], "train")))
    n = keys.num_rows
    place = np.empty(n, np.int64)
    place[pc.sort_indices(keys, [("season", "ascending"), ("game_id", "ascending")]).to_numpy()] = np.arange(n)
    del keys
    at, out = 0, {}
    for part in _parts(path, g, names):
        to = place[at : at + len(part.y)]
        at += len(part.y)
        for c, v in zip(M.Data._fields[:-1], part[:-1], strict=True):
            if c not in out:
                out[c] = np.empty((n, *v.shape[1:]), v.dtype)
            out[c][to] = v
    return M.Data(**out, teams=len(names))


_DRAWS = "g int, chain int, draw int, values array<double>, divergences long"


_CELLS = "g int, home int, away int, neutral double, sums array<double>"
_STEP = "g int, effects array<double>, scales array<double>, tried array<double>, value double, near boolean"


class Large(NamedTuple):
    """A group of many rows: how many covariates, its files, where sums over its cells are, and its mode."""

    covariates: int
    files: list[str]
    cells: str
    mode: M.Search

    def shape(self, teams: int) -> M.Data:
        return M.Data(np.empty((0, self.covariates)), *[np.empty(0)] * 5, teams)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _sum_cells(batches: Iterator[pa.RecordBatch], tasks: Sequence[tuple[int, str]], design: str, names: Mapping[int, Sequence[str]], at: Mapping[int, np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
    """Sums over the cells of a file, whose rows come cell by cell; what is cut off by a batch waits for the next."""
    for g, name in (tasks[i] for batch in batches for i in batch["id"].to_pylist()):
        held = None
        for part in itertools.chain(_parts(design, g, names[g], [name]), [None]):
            if held is not None:
                part, last = (held, True) if part is None else (M.Data(*map(np.concatenate, zip(held[:-1], part[:-1], strict=True)), held.teams), False)
            elif part is None:
                break
            else:
                last = False
            cut = len(part.y) if last else int(M.pieces(part)[-1])
            held = M.part_of(part, cut, len(part.y))
            if not cut:
                continue
            for first, sums in M.piece_sums(at[g], M.part_of(part, 0, cut), order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), g, np.int32)), pa.array(first.home.astype(np.int32)), pa.array(first.away.astype(np.int32)), pa.array(first.neutral), _lists(sums)], names=["g", "home", "away", "neutral", "sums"])


def _cells(path: str, g: int, group: Large, teams: int, effects: np.ndarray, order: int) -> M.Cells:
    """Sums over cells that tasks have written, in one order whoever wrote them."""
    rows = pa.Table.from_batches(list(_read(path, g, ["home", "away", "neutral", "sums"])))
    sums = rows["sums"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    keys = [rows[c].to_numpy() for c in ("home", "away", "neutral")]
    place = np.lexsort([*sums.T[:3], *keys[::-1]])
    home, away, neutral = (k[place] for k in keys)
    return M.Cells(effects, group.shape(teams)._replace(home=home.astype(np.int64), away=away.astype(np.int64), neutral=neutral), sums[place], order)


def _step(batches: Iterator[pa.RecordBatch], some: Sequence[int], groups: Mapping[int, Large], names: Mapping[int, Sequence[str]], sums: str, priors: M.Priors) -> Iterator[pa.RecordBatch]:
    for g in (some[i] for batch in batches for i in batch["id"].to_pylist()):
        own = groups[g].mode
        new = M.searched(own, _cells(sums, g, groups[g], len(names[g]), own.tried, 2), priors)
        made = [_lists(np.array(v)[None]) for v in (new.effects, new.scales, new.tried)]
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *made, pa.array([float(new.value)]), pa.array([new.near])], names=["g", "effects", "scales", "tried", "value", "near"])


def _modes(spark: SparkSession, design: str, names: Mapping[int, Sequence[str]], covariates: Mapping[int, int], priors: M.Priors) -> dict[int, Large]:
    """The mode of each group, and sums over its cells there: a pass of all tasks over the rows a step, and one for the sums."""
    at = {g: Large(k, _files(design, g), "", None) for g, k in covariates.items()}
    at = {g: v._replace(mode=M.search(v.shape(len(names[g])), priors)) for g, v in at.items()}

    def passed(some: Sequence[int], order: int) -> str:
        path, tasks = shared_folder(spark, "cells"), [(g, f) for g in some for f in at[g].files]
        run = functools.partial(_sum_cells, tasks=tasks, design=design, names={g: names[g] for g in some}, at={g: at[g].mode.tried for g in some}, order=order)
        spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, _CELLS).write.partitionBy("g").parquet(path)
        return path

    for _ in range(MODE_STEPS):
        some = [g for g, v in at.items() if not v.mode.near]
        if not some:
            break
        path = passed(some, 2)
        step = functools.partial(_step, some=some, groups=at, names={g: names[g] for g in some}, sums=path, priors=priors)
        for r in spark.range(0, len(some), 1, len(some)).mapInArrow(step, _STEP).collect():
            at[r["g"]] = at[r["g"]]._replace(mode=M.Search(np.array(r["effects"]), tuple(r["scales"]), np.array(r["tried"]), r["value"], r["near"]))
        dropped(path)
    path = passed(list(at), M.ORDER)
    return {g: v._replace(cells=path) for g, v in at.items()}


def _rows_likelihood(path: str, g: int, names: Sequence[str], rows: int) -> Callable[[np.ndarray], float]:
    """The log likelihood of all rows of a group; they are held from the first time on, or read each time where they are many."""
    held: list[M.Data] = []

    def passed(effects: np.ndarray) -> float:
        if rows > HELD_ROWS:
            return math.fsum(M.log_likelihood(effects, d) for d in _parts(path, g, names))
        if not held:
            held.append(training_data(path, g, names))
        return M.log_likelihood(effects, held[0])

    return passed


def _chain(path: str, g: int, names: Sequence[str], group: Large | None, rows: int, priors: M.Priors, rng: np.random.Generator, warmup: int, samples: int) -> tuple[np.ndarray, int]:
    if group is None:
        return M.hmc(training_data(path, g, names), priors, rng, warmup, samples)
    cells = _cells(group.cells, g, group, len(names), group.mode.tried, M.ORDER)
    around = M.Expansion(group.mode.tried, *cells.curvature(), group.mode.scales)
    return M.hmc(group.shape(len(names)), priors, rng, warmup, samples, around=around, cells=cells, rows=_rows_likelihood(path, g, names, rows))


def _sample(batches: Iterator[pa.RecordBatch], tasks: Sequence[tuple[int, int]], design: str, names: Mapping[int, Sequence[str]], large: Mapping[int, Large], rows: Mapping[int, int], priors: M.Priors, seed: int, warmup: int, samples: int) -> Iterator[pa.RecordBatch]:
    for g, chain in (tasks[i] for batch in batches for i in batch["id"].to_pylist()):
        rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(g, chain)))
        draws, bad = _chain(design, g, names[g], large.get(g), rows[g], priors, rng, warmup, samples)
        n = len(draws)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, chain, np.int32)), pa.array(np.arange(n, dtype=np.int32)), _lists(draws), pa.array(np.full(n, bad))], names=["g", "chain", "draw", "values", "divergences"])


def fit(design: DataFrame, priors: M.Priors = M.Priors(), seed: int = 0, chains: int = M.CHAINS, warmup: int = M.WARMUP, samples: int = M.SAMPLES, sealed: str | None = None) -> Fits:
    """Samples the posterior of every group of a design, a task for each group and chain.

    Training rows of the ``sealed`` season, or without a season, are refused
    before anything is sampled, whatever comes with them. Rows that lack an
    outcome, a rating or a covariate are refused too. Where a group has many
    rows, all tasks sum them over cells first, and a chain reads these sums.
    The caller judges the draws by ``diagnostics`` and ``assert_sound``.
    """
    from plumbline.sources.seal import assert_dev_only

    spark, train = design.sparkSession, design.where("role = 'train'")
    if sealed is not None:
        assert_dev_only(train, sealed)
    lacking = F.col("y").isNull() | F.col("rating").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    path, drawn, cell = shared_folder(spark, "design"), shared_folder(spark, "draws"), ["home", "away", "neutral"]
    design.select(*DESIGN).repartition(2 * spark.sparkContext.defaultParallelism, "g", *cell).sortWithinPartitions("g", "role", *cell, "season", "game_id").write.partitionBy("g").parquet(path)
    train = spark.read.parquet(path).where("role = 'train'")
    sizes = {r["g"]: r for r in train.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(lacking, 1)).alias("bad"), F.max(F.size("x")).alias("k")).collect()}
    if bad := sum(r["bad"] for r in sizes.values()):
        raise ValueError(f"{bad} training rows lack an outcome, a rating or a covariate")
    found = train.select("g", F.explode(F.array("home", "away")).alias("name")).distinct().collect()  # a row for each team and season
    if not found:
        raise ValueError("no training rows")
    names = {g: sorted(r["name"] for r in found if r["g"] == g) for g in sorted({r["g"] for r in found})}
    many = {g: sizes[g]["k"] for g, n in names.items() if sizes[g]["n"] > SUMMED_ROWS and sizes[g]["n"] >= M.EXPANDED_ROWS * (5 + sizes[g]["k"] + 2 * len(n))}
    large = _modes(spark, path, names, many, priors) if many else {}
    tasks = [(g, c) for g in names for c in range(chains)]
    sample = functools.partial(_sample, tasks=tasks, design=path, names=names, large=large, rows={g: r["n"] for g, r in sizes.items()}, priors=priors, seed=seed, warmup=warmup, samples=samples)
    spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(sample, _DRAWS).write.partitionBy("g").parquet(drawn)
    return Fits(path, drawn, names)


def draws_of(spark: SparkSession, fits: Fits) -> DataFrame:
    return spark.read.schema(_DRAWS).parquet(fits.draws)


def diagnostics(spark: SparkSession, fits: Fits) -> DataFrame:
    """By group and parameter: R-hat, divergences and chains."""
    return M.diagnostics(draws_of(spark, fits), ["g"])


def assert_sound(found: DataFrame) -> None:
    """Refuses diagnostics of which any group's chains disagree or have diverged, and names the groups."""
    worst = found.groupBy("g").agg(F.max("rhat").alias("rhat"), F.max("divergences").alias("divergences"), F.min("chains").alias("chains")).collect()
    bad = [r.asDict() for r in worst if r["chains"] < 2 or r["rhat"] > M.MAX_RHAT or r["divergences"]]
    if bad or not worst:
        raise M.DiagnosticsError(str(sorted(bad, key=lambda r: r["g"]) or "no draws"))


def _unseen(name: str, seed: int, chains: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Standard effects, overall and at home, of a team and season that no fit has seen: drawn anew for each draw, by chain and number."""
    out = np.empty((len(draws), 2))
    for chain in np.unique(chains).tolist():
        rng = np.random.Generator(np.random.Philox(key=np.array([seed, (chain << 32) | zlib.crc32(name.encode())], np.uint64)))
        own = chains == chain
        out[own] = rng.standard_normal((int(draws[own].max()) + 1, 2))[draws[own]]
    return out.T


class _Posterior:
    """All draws of a group: what a game's linear predictor is made of, by draw; sides that the fit hasn't seen are drawn when they are met."""

    def __init__(self, fits: Fits, g: int, covariates: int, seed: int):
        blocks = [b for b in _read(fits.draws, g, ["chain", "draw", "values"]) if b.num_rows]
        if not blocks:
            raise ValueError(f"no draws of group {g}")
        self.g, self.seed = g, seed
        self.chain, self.draw = (np.concatenate([b[c].to_numpy() for b in blocks]) for c in ("chain", "draw"))
        t = np.concatenate([b["values"].flatten().to_numpy().reshape(b.num_rows, -1) for b in blocks])
        k, teams = covariates, len(fits.names[g])
        self.alpha, self.home, self.slopes = t[:, 0].copy(), t[:, 1].copy(), t[:, 2 : 3 + k].T.copy()
        self.scales = np.exp(t[:, 3 + k]), np.exp(t[:, 4 + k])
        own = [(s[:, None] * t[:, at : at + teams]).T.copy() for s, at in zip(self.scales, (5 + k, 5 + k + teams), strict=True)]
        self.seen, self.effects = set(fits.names[g]), dict(zip(fits.names[g], zip(*own, strict=True), strict=True))

    def of(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Effects of a side, overall and at home, by draw."""
        if name not in self.effects:
            self.effects[name] = tuple(s * z for s, z in zip(self.scales, _unseen(name, self.seed, self.chain, self.draw), strict=True))
        return self.effects[name]

    def chances(self, home: str, away: str, at_home: float, z: np.ndarray) -> np.ndarray:
        """Mean chances, over the draws, of games of two sides; a few games at a time."""
        (team, host), other = self.of(home), self.of(away)[0]
        base = self.alpha + team - other + at_home * (self.home + host)
        out, some = np.empty(len(z)), max(1, BLOCK_CHANCES // len(base))
        with np.errstate(over="ignore"):
            for i in range(0, len(z), some):
                odds = z[i : i + some] @ self.slopes
                odds += base
                np.negative(odds, out=odds)
                np.exp(odds, out=odds)
                odds += 1.0
                np.reciprocal(odds, out=odds)
                out[i : i + some] = odds.mean(axis=1)
        return out


def _predict(batches: Iterator[pa.RecordBatch], fits: Fits, seed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        groups, x = batch["g"].to_numpy(), batch["x"]
        sides = [batch[c].to_pylist() for c in ("home", "away")]
        codes = [pa.array(s, pa.string()).dictionary_encode(null_encoding="encode").indices.to_numpy() for s in sides]
        rating = batch["rating"].to_numpy(zero_copy_only=False)
        p, strange = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, bool)
        at_home = 1.0 - batch["neutral"].to_numpy(zero_copy_only=False)
        order = np.lexsort([at_home, *codes, groups])
        turns = np.any([v[order][1:] != v[order][:-1] for v in (at_home, *codes, groups)], axis=0)
        for at in np.split(order, np.flatnonzero(turns) + 1) if batch.num_rows else ():
            g, home, away = int(groups[at[0]]), sides[0][at[0]], sides[1][at[0]]
            rows = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            if own is None or own.g != g:
                own = _Posterior(fits, g, rows.shape[1], seed)
            strange[at] = home not in own.seen or away not in own.seen
            p[at] = own.chances(home, away, float(at_home[at[0]]), np.column_stack([rating[at], rows]))
        kept = [batch[c] for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array(strange)], schema=schema)


def predictive(games: DataFrame, fits: Fits, seed: int = 0) -> DataFrame:
    """``games`` (columns of a design and others) with ``p``, the mean probability over all draws of their group, and ``unseen``.

    A team and season that the fit hasn't seen isn't set to nought: its effects
    are drawn from their prior for each draw, the same for all its games. Games
    stay where they are, sorted by group; a task holds the draws of one group, and
    meets games of the same sides together. A group without draws is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    kept = [f for f in games.schema if f.name != "x"]
    schema = StructType([*kept, StructField("p", DoubleType()), StructField("unseen", BooleanType())])
    return games.sortWithinPartitions("g", "home", "away").mapInArrow(functools.partial(_predict, fits=fits, seed=seed, schema=to_arrow_schema(schema)), schema)


def _by_fold(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(table), "g")  # a row for each sport and fold


def rolling_design(df: DataFrame, origins: Sequence[int], filled: Sequence[str], covariates: Mapping[str, Sequence[str]]) -> DataFrame:
    """A design with a group for each sport and origin: games that had started before it to train on, those up to the next to test.

    Medians that fill gaps, and means and deviations that standardise, are those
    of a fold's own training rows. ``df`` has the features of both sides, the
    difference of ratings, ``y`` and ``start_t``; rows without an outcome take no
    part. A sport whose fold lacks either side, or a median, is refused.
    """
    spark, sports = df.sparkSession, sorted(covariates)
    order = F.array(*map(F.lit, sports))
    known = df.where(F.col("y").isNotNull() & F.col("sport").isin(sports))
    rows = M.folds(known, origins).withColumn("g", ((F.array_position(order, F.col("sport")) - 1) * len(origins) + F.col("fold")).cast("int"))
    train = lambda c: F.when(F.col("role") == "train", c)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    middle = rows.groupBy("g").agg(F.count(train(F.lit(1))).alias("n_train"), F.count(F.when(F.col("role") == "test", 1)).alias("n_test"), *(F.median(train(number(c))).alias(f"med_{c}") for c in filled)).collect()
    found = {r["g"]: r for r in middle}
    for g in range(len(sports) * len(origins)):
        r = found.get(g)
        if r is None or not r["n_train"] or not r["n_test"]:
            raise ValueError(f"{sports[g // len(origins)]}, fold {g % len(origins)}: {r['n_train'] if r else 0} games to train on and {r['n_test'] if r else 0} to test")
        if lacking := [c for c in filled if r[f"med_{c}"] is None]:
            raise ValueError(f"{sports[g // len(origins)]}, fold {g % len(origins)}: no median of {lacking}")
    told = spark.createDataFrame([(r["g"], *(float(r[f"med_{c}"]) for c in filled)) for r in middle], "g int" + "".join(f", `med_{c}` double" for c in filled))
    whole = _by_fold(rows, told).withColumns({c: F.coalesce(number(c), F.col(f"med_{c}")) for c in filled}).withColumns({f"{s}_b2b": F.coalesce(F.col(f"{s}_b2b").cast("int"), F.lit(0)).cast("double") for s in ("home", "away")})
    terms = M.derive_terms(whole)
    scaled = list(dict.fromkeys([*(c for s in sports for c in covariates[s]), "rating_diff"]))
    scale = written(terms.groupBy("g").agg(*(F.avg(train(F.col(c))).alias(f"m_{c}") for c in scaled), *(F.stddev_pop(train(F.col(c))).alias(f"s_{c}") for c in scaled)), "scale")
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    x = functools.reduce(lambda out, s: out.when(F.col("sport") == s, F.array(*(z(c) for c in covariates[s])).cast("array<double>")), sports, F.when(F.lit(False), F.array().cast("array<double>")))
    name = lambda side: F.concat_ws(":", "season", side).alias(side)
    return _by_fold(terms, scale).select("g", "role", "sport", "fold", "season", "game_id", name("home"), name("away"), F.coalesce(F.col("neutral").cast("double"), F.lit(0.0)).alias("neutral"), F.col("y").cast("double").alias("y"), z("rating_diff").alias("rating"), x.alias("x"))


def rolling_forecasts(design: DataFrame, seed: int = 0, sealed: str | None = None, **sizes: int) -> DataFrame:
    """Forecasts of every fold's test games by its own fit: sport, fold, season, game_id, y, p, unseen. A fold whose chains are unsound refuses all."""
    spark = design.sparkSession
    fits = fit(design, seed=seed, sealed=sealed, **sizes)
    assert_sound(diagnostics(spark, fits))
    found = predictive(design.where("role = 'test'"), fits, seed).select("sport", "fold", "season", "game_id", "y", "p", "unseen")
    return written(found, "forecasts")  # scores pass over them more than once


def pooled(forecasts: DataFrame) -> DataFrame:
    """By sport, the scores of all folds' forecasts together, and how many games have a side that no fit had seen."""
    unseen = forecasts.groupBy("sport").agg(F.count(F.when(F.col("unseen"), 1)).alias("unseen"), F.count_distinct("fold").alias("folds"))
    return score_set(forecasts, ["sport"]).join(unseen, "sport")


def sensitivity(design: DataFrame, seed: int = 0, factors: Sequence[float] = (0.5, 1.0, 2.0), tolerance: float = 0.25, **sizes: int) -> DataFrame:
    """By group, posterior means of both scales under wider and narrower priors; ``prior_driven`` where a mean moves by more than the tolerance, relative to that at factor 1."""
    spark, out = design.sparkSession, None
    for name, at in (("team", 2), ("team_home", 1)):
        for factor in factors:
            priors = M.Priors()._replace(**{name: getattr(M.Priors(), name) * factor})
            fits = fit(design, priors, seed, **sizes)
            size = F.create_map(*(F.lit(v) for g, n in fits.names.items() for v in (g, len(n))))[F.col("g")]  # what stands behind the scales: two effects a team and season
            place = F.size("values") - 2 * size - at
            one = draws_of(spark, fits).groupBy("g").agg(F.lit(name).alias("scale"), F.lit(float(factor)).alias("factor"), F.avg(F.exp(F.get("values", place))).alias("mean"))
            out = one if out is None else out.unionByName(one)
    base = F.max(F.when(F.col("factor") == 1.0, F.col("mean"))).over(Window.partitionBy("g", "scale"))
    return out.withColumn("prior_driven", F.abs(F.col("mean") / base - 1) > tolerance)
