"""Elo ratings with results that become public after a delay.

The walk over a sport is sequential: each game's forecast hangs on all results
public by its start, so a sport is a task. Spark sorts the games, and a task
meets them batch by batch and holds only ratings and what isn't public yet.
Games that start before the first of them is public are taken at once. The
points of a grid don't hang on each other: tasks share them out, and each walks
its own together, ratings being arrays over them.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import MARGIN_ADD, MARGIN_BASE, MARGIN_EDGE, MARGIN_POWER, RATING_SCALE, RATING_START
from plumbline.schemas import RESULT_DELAY
from plumbline.sources.scratch import opened, shared_folder


class Setting(NamedTuple):
    """Step size, home bonus, and share of a rating that a new season keeps; arrays stand for as many walks at once."""

    k: float
    home: float
    carry: float


class Game(NamedTuple):
    season: str
    game_id: object
    start_t: int
    away: str
    home: str
    away_pts: float
    home_pts: float
    neutral: bool


class Forecast(NamedTuple):
    game_id: object
    season: str
    start_t: int
    away: str
    home: str
    r_away: float
    r_home: float
    p_home: float
    y: float


def expected(edge: float) -> float:
    """The chance of a side with this edge; 0 where ten to its power is beyond floating point, as arrays and columns have it."""
    try:
        return 1 / (1 + 10 ** (-edge / RATING_SCALE))
    except OverflowError:
        return 0.0


class Walk:
    """Ratings as they are known in event time; updates wait until they are public."""

    def __init__(self, setting: Setting, delay: int):
        self.setting, self.delay = setting, delay
        self.rating: dict[str, float] = {}
        self.season: dict[str, str] = {}
        self.waiting: list[tuple[int, int, str, float]] = []
        self.count = 0

    def settle(self, now: int | None = None) -> None:
        """Applies what is public by ``now``, in the order in which it became so; all of it without a time."""
        while self.waiting and (now is None or self.waiting[0][0] <= now):
            _, _, team, change = heapq.heappop(self.waiting)
            self.rating[team] = self.rating[team] + change

    def _enter(self, team: str, season: str) -> float:
        if team not in self.rating:
            self.rating[team] = RATING_START
        elif self.season[team] != season:
            self.rating[team] = RATING_START + self.setting.carry * (self.rating[team] - RATING_START)
        self.season[team] = season
        return self.rating[team]

    def play(self, g: Game) -> Forecast:
        self.settle(g.start_t)
        r_away, r_home = self._enter(g.away, g.season), self._enter(g.home, g.season)
        edge = r_home - r_away + (0.0 if g.neutral else self.setting.home)
        p = expected(edge)
        margin = abs(g.home_pts - g.away_pts)
        if not margin > 0:
            raise ValueError(f"game {g.game_id} has no winner")
        y = 1.0 if g.home_pts > g.away_pts else 0.0
        change = self.setting.k * (margin + MARGIN_ADD) ** MARGIN_POWER / (MARGIN_BASE + MARGIN_EDGE * (edge if y else -edge)) * (y - p)
        for team, own in ((g.home, change), (g.away, -change)):
            heapq.heappush(self.waiting, (g.start_t + self.delay, self.count, team, own))
            self.count += 1
        return Forecast(g.game_id, g.season, g.start_t, g.away, g.home, r_away, r_home, p, y)


def games_of(rows: pd.DataFrame) -> Iterator[Game]:
    ordered = rows.sort_values(["start_t", "game_id"], kind="stable")
    columns = (ordered[c].tolist() for c in ("season", "game_id", "start_t", "away", "home", "away_pts", "home_pts", "neutral_site"))
    for season, game_id, start_t, away, home, away_pts, home_pts, neutral in zip(*columns, strict=True):
        yield Game(season, game_id, int(start_t), away, home, float(away_pts), float(home_pts), bool(neutral) and neutral == neutral)


def walk(games: Iterable[Game], setting: Setting, delay: int) -> tuple[list[Forecast], dict[str, float]]:
    """Forecasts in order, and the ratings once all results are public."""
    own = Walk(setting, delay)
    out = [own.play(g) for g in games]
    own.settle()
    return out, own.rating


INPUT = ("sport", "season", "game_id", "start_t", "away", "home", "away_pts", "home_pts", "neutral_site")
#: Games of a sorted file that a task meets at a time, and bytes of a row group.
BATCH_GAMES, ROW_GROUP = 16_384, 1 << 23


def _delay(sport: str, delays: Mapping[str, int]) -> int:
    return delays.get(sport, max(delays.values()))


def _played(games: DataFrame) -> DataFrame:
    """What a walk reads of games: margins of the home side, and 1 where it is at home."""
    neutral = F.col("neutral_site").cast("boolean") & ~F.isnan(F.col("neutral_site").cast("double"))
    margin = F.col("home_pts").cast("double") - F.col("away_pts").cast("double")
    return games.select(*INPUT[:3], F.col("start_t").cast("long").alias("start_t"), *INPUT[4:6], margin.alias("margin"), F.when(neutral, 0.0).otherwise(1.0).alias("at_home"))


def _in_order(games: DataFrame, step: Callable[[str], Stepper], schema: str) -> DataFrame:
    """What a stepper of each sport makes of its games, which come in batches by start and game; the sort may spill, and no task holds a sport."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sport, own = None, None
        for batch in batches:
            sports = np.array(batch["sport"].to_pylist(), object)
            cuts = [0, *(np.flatnonzero(sports[1:] != sports[:-1]) + 1).tolist(), len(sports)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if own is None or sports[a] != sport:
                    if own is not None:
                        yield from own.end()
                    sport, own = sports[a], step(sports[a])
                yield from own.meet(batch.slice(a, b - a))
        if own is not None:
            yield from own.end()

    tasks = games.sparkSession.sparkContext.defaultParallelism
    order = [F.col(c).asc_nulls_last() for c in ("sport", "start_t", "game_id")]
    return _played(games).repartition(tasks, "sport").sortWithinPartitions(*order).mapInArrow(run, schema)


class Stepper(NamedTuple):
    """``meet`` takes the next games of a sport, ``end`` is called after the last; either may give rows."""

    meet: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]
    end: Callable[[], Iterable[pa.RecordBatch]]


def ratings(games: DataFrame, settings: Mapping[str, Setting], delays: Mapping[str, int] = RESULT_DELAY) -> DataFrame:
    """A forecast from the ratings before each game; one walk per sport."""
    kinds = {f.name: f.dataType.simpleString() for f in games.schema}
    schema = f"sport string, game_id {kinds['game_id']}, season string, start_t long, away string, home string, r_away double, r_home double, p_home double, y double"

    def step(sport: str) -> Stepper:
        own = GridWalk(Setting(*(np.array([float(v)]) for v in settings[sport])), _delay(sport, delays))

        def meet(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts = [(r.r_away[:, 0], r.r_home[:, 0], r.p[:, 0], r.y[:, 0]) for r in own.play(rows)]
            made = dict(zip(Forecast._fields[5:], map(np.concatenate, zip(*parts, strict=True)), strict=True))
            told = ["sport", *Forecast._fields[:5]]
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in told), *map(pa.array, made.values())], names=[*told, *made])

        return Stepper(meet, lambda: [])

    return _in_order(games, step, schema)


def final_ratings(games: DataFrame, settings: Mapping[str, Setting], delays: Mapping[str, int] = RESULT_DELAY) -> DataFrame:
    def step(sport: str) -> Stepper:
        own = GridWalk(Setting(*(np.array([float(v)]) for v in settings[sport])), _delay(sport, delays))

        def meet(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for _ in own.play(rows):
                pass
            return []

        def end() -> Iterator[pa.RecordBatch]:
            own.settle()
            teams = sorted(own.index)
            yield pa.RecordBatch.from_arrays([pa.array([sport] * len(teams), pa.string()), pa.array(teams, pa.string()), pa.array(own.rating[[own.index[t] for t in teams], 0])], names=["sport", "team", "rating"])

        return Stepper(meet, end)

    return _in_order(games, step, "sport string, team string, rating double")


class Run(NamedTuple):
    """Games taken at once: their season, and by (game, point) ratings before them, chance and outcome."""

    season: str
    r_away: np.ndarray
    r_home: np.ndarray
    p: np.ndarray
    y: np.ndarray


class GridWalk:
    """``Walk`` of many settings over runs of games: (team, point) ratings, updates in the order in which they become public.

    A run is of games that start before the result of its first is public.
    What becomes public while it lasts was played before it, so each team's
    ratings in time are known at once: its changes added up one after another.
    """

    def __init__(self, points: Setting, delay: int):
        self.points, self.delay = points, delay
        self.index: dict[str, int] = {}
        self.seasons: dict[str, int] = {}
        self.season = np.empty(0, np.int64)
        self.rating = np.empty((0, len(points.k)))
        self.waiting: deque[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = deque()

    def _due(self, now: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times, teams and changes of what is public by ``now``, in order; it waits no longer."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, self.rating.shape[1])))]
        while self.waiting and (now is None or self.waiting[0][0][0] <= now):
            public, away, home, change = self.waiting.popleft()
            m = len(public) if now is None else int(np.searchsorted(public, now, side="right"))
            if m < len(public):
                self.waiting.appendleft((public[m:], away[m:], home[m:], change[m:]))
            parts.append((np.repeat(public[:m], 2), np.column_stack([home[:m], away[:m]]).ravel(), np.stack([change[:m], -change[:m]], axis=1).reshape(2 * m, -1)))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def settle(self, now: int | None = None, sides: np.ndarray = np.empty(0, np.int64), start: np.ndarray = np.empty(0, np.int64), season: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Applies what is public by ``now``. ``sides`` are teams that play at ``start``: all their levels until then, and the row of each side's own."""
        public, changed, change = self._due(now)
        teams, of = np.unique(np.concatenate([sides, changed]), return_inverse=True)
        side, event = of[: len(sides)], of[len(sides) :]
        order = np.argsort(event, kind="stable")
        event, public = event[order], public[order]
        ends = np.cumsum(np.bincount(event, minlength=len(teams)) + 1)
        heads = np.concatenate([[0], ends[:-1]])[: len(teams)]
        levels = np.empty((len(teams) + len(event), self.rating.shape[1]))
        levels[heads] = self.rating[teams]
        levels[np.arange(len(event)) + event + 1] = change[order]
        times = np.concatenate([public, start])
        first, width = (int(times.min()), int(np.ptp(times)) + 1) if len(times) else (0, 1)
        own = np.searchsorted(event * width + (public - first), side * width + (start - first), side="right") + side
        entry = np.full(len(teams), -1)
        entry[side[::-1]] = own[::-1]
        np.minimum.at(entry, side, own)
        entry[self.season[teams] == season] = -1
        for a, b, at in zip(heads.tolist(), ends.tolist(), entry.tolist(), strict=True):
            if at >= 0:  # a new season keeps a share of what is known when the team first plays in it
                np.cumsum(levels[a : at + 1], axis=0, out=levels[a : at + 1])
                levels[at] = RATING_START + self.points.carry * (levels[at] - RATING_START)
                a = at
            if b - a > 1:
                np.cumsum(levels[a:b], axis=0, out=levels[a:b])
        self.rating[teams] = levels[ends - 1]
        self.season[sides] = season
        return levels, own

    def _numbers(self, names: pa.Array) -> np.ndarray:
        coded = names.dictionary_encode(null_encoding="encode")
        own = [self.index.setdefault(n, len(self.index)) for n in coded.dictionary.to_pylist()]
        if new := len(self.index) - len(self.season):
            self.season = np.append(self.season, np.full(new, -1))
            self.rating = np.concatenate([self.rating, np.full((new, self.rating.shape[1]), RATING_START)])
        return np.array(own, np.int64)[coded.indices.to_numpy()]

    def play(self, rows: pa.RecordBatch) -> Iterator[Run]:
        """Runs of games of ``_played``, which come in order."""
        margin, start, at_home = (rows[c].to_numpy(zero_copy_only=False) for c in ("margin", "start_t", "at_home"))
        if not np.all(np.abs(margin) > 0):
            raise ValueError(f"game {rows['game_id'][int(np.flatnonzero(~(np.abs(margin) > 0))[0])]} has no winner")
        away, home = self._numbers(rows["away"]), self._numbers(rows["home"])
        coded = rows["season"].dictionary_encode(null_encoding="encode")
        names, seasons = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        turns = np.append(np.flatnonzero(np.diff(seasons)) + 1, len(start))
        i = 0
        while i < len(start):
            to = min(max(i + 1, int(np.searchsorted(start, start[i] + self.delay, side="left"))), int(turns[np.searchsorted(turns, i, side="right")]))
            own, name = slice(i, to), names[seasons[i]]
            levels, at = self.settle(int(start[to - 1]), np.concatenate([away[own], home[own]]), np.tile(start[own], 2), self.seasons.setdefault(name, len(self.seasons)))
            r_away, r_home = levels[at[: to - i]], levels[at[to - i :]]
            edge = r_home - r_away + at_home[own, None] * self.points.home
            with np.errstate(over="ignore"):
                p = expected(edge)
            y = (margin[own] > 0).astype(float)[:, None]
            size = (np.abs(margin[own]) + MARGIN_ADD) ** MARGIN_POWER
            change = self.points.k * size[:, None] / (MARGIN_BASE + MARGIN_EDGE * np.where(y > 0, edge, -edge)) * (y - p)
            self.waiting.append((start[own] + self.delay, away[own], home[own], change))
            yield Run(name, r_away, r_home, p, y)
            i = to


def _sorted_files(games: DataFrame) -> str:
    """A shared folder with the games by sport, start and number: each file in order, and one after another by name."""
    path, tasks = shared_folder(games.sparkSession, "schedule"), games.sparkSession.sparkContext.defaultParallelism
    order = [F.col(c).asc_nulls_last() for c in ("sport", "start_t", "game_id")]
    _played(games).repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def _schedule(path: str, sport: str | None) -> Iterator[pa.RecordBatch]:
    """The games of a sport in order, batch by batch."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    store, root = opened(path)
    for name in sorted(f.path for f in store.get_file_info(FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            bounds = [file.metadata.row_group(i).column(0).statistics for i in range(file.num_row_groups)]  # of the first column, the sport
            some = [i for i, s in enumerate(bounds) if sport is None or s is None or not s.has_min_max or s.min <= sport <= s.max]
            for batch in file.iter_batches(BATCH_GAMES, row_groups=some, use_threads=False):  # a dataset would read ahead
                yield batch.filter(pc.is_null(batch["sport"]) if sport is None else pc.equal(batch["sport"], sport))


def grid_search(games: DataFrame, grid: Sequence[Setting] | Mapping[str, Sequence[Setting]], season: str, delays: Mapping[str, int] = RESULT_DELAY) -> DataFrame:
    """Scores of each point over the games of one season, best first: log loss, then smaller k and bonus, then larger carry.

    A grid by sport leaves out the others. The schedule is sorted once, in files
    that all tasks read batch by batch; a task walks a sport with some of the
    points, and only scores come back. Without a game of the season scores are null.
    """
    own = games.where(F.col("sport").isin(list(grid))) if isinstance(grid, Mapping) else games
    spark, path = games.sparkSession, _sorted_files(own)
    sports = [r["sport"] for r in spark.read.parquet(path).select("sport").distinct().orderBy("sport").collect()]
    parts = -(-spark.sparkContext.defaultParallelism // max(1, len(sports)))
    shares = [(s, points[i::parts]) for s in sports for points in [grid[s] if isinstance(grid, Mapping) else grid] for i in range(min(parts, len(points)))]
    names = ["sport", "k", "home_bonus", "carry", "n", "log_loss", "brier"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sport, some in (shares[i] for batch in batches for i in batch["id"].to_pylist()):
            points = Setting(*(np.array(v, float) for v in zip(*some, strict=True)))
            walked, n, sums = GridWalk(points, _delay(sport, delays)), 0, np.zeros((2, len(some)))
            for rows in _schedule(path, sport):
                for r in walked.play(rows):
                    if r.season == season:
                        q = np.clip(r.p, 1e-15, 1 - 1e-15)
                        n += len(r.y)
                        sums[0] -= np.log(np.where(r.y > 0, q, 1 - q)).sum(axis=0)
                        sums[1] += ((r.p - r.y) ** 2).sum(axis=0)
            made = [points.k, points.home, points.carry, np.full(len(some), n), *(v / n if n else np.full(len(some), None) for v in sums)]
            kinds = [pa.float64()] * 3 + [pa.int64()] + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([sport] * len(some), pa.string()), *map(pa.array, made, kinds)], names=names)

    tasks = spark.range(0, len(shares), 1, max(1, len(shares)))
    scores = tasks.mapInArrow(run, "sport string, k double, home_bonus double, carry double, n long, log_loss double, brier double")
    # a row for each sport and point; an orderBy would make them twice, to find its bounds
    return scores.repartition(1).sortWithinPartitions("sport", "log_loss", "k", "home_bonus", F.desc("carry"))


def leaders(scores: DataFrame, n: int = 10) -> DataFrame:
    """Of a grid's scores the ``n`` best of each sport and the worst, with ``place`` from 1 and ``spread``, the worst log loss less the best."""
    own = Window.partitionBy("sport")
    ranked = scores.withColumn("place", F.row_number().over(own.orderBy("log_loss", "k", "home_bonus", F.desc("carry")))).withColumns({"points": F.count(F.lit(1)).over(own), "spread": F.max("log_loss").over(own) - F.min("log_loss").over(own)})
    return ranked.where((F.col("place") <= n) | (F.col("place") == F.col("points"))).drop("points")


def on_edge(best: Setting, grid: Sequence[Setting]) -> list[str]:
    """Names of the parameters whose best value is the least or largest tried: the grid may end too soon."""
    return [f for f in Setting._fields if len({getattr(s, f) for s in grid}) > 1 and getattr(best, f) in (min(getattr(s, f) for s in grid), max(getattr(s, f) for s in grid))]


def causality(games: DataFrame, settings: Mapping[str, Setting], cutoff: int, delays: Mapping[str, int] = RESULT_DELAY) -> DataFrame:
    """Forecasts before the cutoff that change if later games are taken away: none."""
    full = ratings(games, settings, delays).where(F.col("start_t") < cutoff)
    cut = ratings(games.where(F.col("start_t") < cutoff), settings, delays)
    return full.exceptAll(cut).unionByName(cut.exceptAll(full))
