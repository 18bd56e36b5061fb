"""Elo ratings on a stream: state per sport, updates that wait for their time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from plumbline.operators.elo import INPUT, Forecast, Setting, Walk, games_of
from plumbline.schemas import RESULT_DELAY


def streaming_ratings(games: DataFrame, settings: dict[str, Setting]) -> DataFrame:
    """Forecasts of games that come in order of their start within each sport, batch after batch; results are public a delay later."""

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sport = key[0]
        walk = pickle.loads(state.get[0]) if state.exists else Walk(settings[sport], RESULT_DELAY.get(sport, max(RESULT_DELAY.values())))
        rows = pd.concat(list(batches))
        out = [walk.play(g) for g in games_of(rows)]
        state.update((pickle.dumps(walk),))
        yield pd.DataFrame([(sport, *f) for f in out], columns=["sport", *Forecast._fields])

    kind = games.schema["game_id"].dataType.simpleString()
    schema = f"sport string, game_id {kind}, season string, start_t long, away string, home string, r_away double, r_home double, p_home double, y double"
    return games.select(*INPUT).groupBy("sport").applyInPandasWithState(run, schema, "walk binary", "append", "NoTimeout")
