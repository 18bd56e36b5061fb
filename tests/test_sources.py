"""Snapshots, store, HTTP client, schedules, seal, streams and scalar functions."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.elo import Setting, ratings
from plumbline.operators.outcomes import BooksError
from plumbline.sources import http as H
from plumbline.sources import schedules
from plumbline.sources import snapshot as N
from plumbline.sources.files import read_or_empty, read_required
from plumbline.sources.seal import Seal, SealError, assert_dev_only
from plumbline.sources.store import OutcomeStore
from plumbline.streaming import collector as K
from plumbline.streaming.ratings import streaming_ratings

KEYS = "sport string, season string, game_id string"


def tables(spark):
    games = spark.createDataFrame([("nba", "2011-12", "g1", dt.datetime(2025, 1, 1, 12)), ("nhl", "2024", "g2", None)], f"{KEYS}, start timestamp")
    return {"games": games, "empty": games.limit(0).select("sport", "season"), "plain": spark.range(3)}


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    root = f"file://{tmp_path}"
    name = N.create_snapshot(spark, tables(spark), root)
    assert N.create_snapshot(spark, tables(spark), root) == name and N.latest_snapshot(spark, root).endswith(name)
    other = {**tables(spark), "games": tables(spark)["games"].limit(1)}
    old = N.create_snapshot(spark, other, root, today="20000101")
    assert old.startswith("census-20000101-") and N.latest_snapshot(spark, root).endswith(name)
    path = f"{root}/{name}"
    got = N.open_snapshot(spark, path)
    assert {r.season for r in got["games"].collect()} == {"2011-12", "2024"} and got["empty"].count() == 0 and got["plain"].count() == 3
    assert got["games"].where("game_id = 'g1'").first().start == "2025-01-01T12:00:00+00:00"
    assert spark.table("games").count() == 2
    file = next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / name / "plain") for f in fs if f.endswith(".parquet"))
    copy = file.replace("part-", "part-x")
    os.link(file, copy)
    with pytest.raises(N.SnapshotError, match="extra"):
        N.verify_snapshot(spark, path)
    os.remove(copy)
    N.verify_snapshot(spark, path)
    os.remove(file)
    with pytest.raises(N.SnapshotError, match="missing"):
        N.verify_snapshot(spark, path)


def test_snapshot_is_not_begun_without_room_or_balance(spark, tmp_path):
    def unbalanced():
        raise BooksError("no")

    with pytest.raises(BooksError):
        N.create_snapshot(spark, tables(spark), f"file://{tmp_path}", unbalanced)
    with pytest.raises(N.SnapshotError, match="bytes"):
        N.create_snapshot(spark, tables(spark), f"file://{tmp_path}", free_bytes=10)
    assert os.listdir(tmp_path) == []


def test_store_upserts_move_games_between_tables(spark, tmp_path):
    store = OutcomeStore(spark, f"file://{tmp_path}/s", ["no_market"])
    game = spark.createDataFrame([("nba", "24", "g1"), ("nba", "24", "g2")], KEYS)
    store.put_games(game)
    store.put_games(game)
    assert store.games().count() == 2 and store.pending().count() == 2
    one = game.where("game_id = 'g1'")
    store.put_misses(one.withColumn("reason", F.lit("no_market")))
    assert store.misses().count() == 1 and store.pending().count() == 1
    series = one.withColumns({"side": F.lit("home"), "t": F.array(F.lit(1), F.lit(2)).cast("array<long>"), "p": F.array(F.lit(0.1), F.lit(0.2))})
    store.put_priced(one.withColumn("p_close", F.lit(0.2)), series)
    assert store.misses().count() == 0 and store.priced().count() == 1 and store.quotes().count() == 2
    store.put_priced(one.withColumn("p_close", F.lit(0.3)), series.withColumns({"t": F.array(F.lit(9)).cast("array<long>"), "p": F.array(F.lit(0.9))}))
    assert [r.p for r in store.quotes().collect()] == [0.9] and store.priced().first().p_close == 0.3
    store.put_misses(one.withColumn("reason", F.lit("no_market")))
    assert store.priced().count() == 0 and store.quotes().count() == 0
    with pytest.raises(ValueError):
        store.put_misses(one.withColumn("reason", F.lit("other")))
    store.start_run("r", "{}")
    store.finish_run("r")
    assert store.runs().count() == 1 and store.runs().first().finished_at is not None
    assert OutcomeStore(spark, f"file://{tmp_path}/s", []).version == 2


def test_side_tables_may_be_missing_and_features_may_not(spark, tmp_path):
    assert read_or_empty(spark, f"file://{tmp_path}/none", "a int").columns == ["a"]
    with pytest.raises(FileNotFoundError):
        read_required(spark, f"file://{tmp_path}/none")


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def client(answers, cache=None, **kw):
    clock, it = Clock(), iter(answers)

    def send(url):
        x = next(it)
        if isinstance(x, Exception):
            raise x
        return x

    return H.Client(send, cache, clock=lambda: clock.now, sleep=clock.sleep, **kw), clock


def ok(value):
    return H.Answer(200, {"Content-Type": "application/json"}, json.dumps(value).encode())


def test_client_retries_paces_and_gives_up(tmp_path):
    c, clock = client([OSError(), H.Answer(429, {"Retry-After": "7"}, b""), ok([1])])
    assert c.get_json("u") == [1] and 2.0 in clock.slept and 7.0 in clock.slept
    c, _ = client([H.Answer(404, {}, b"")])
    with pytest.raises(H.StatusError):
        c.get_json("u")
    c, _ = client([OSError()] * 4)
    with pytest.raises(H.NetworkUnavailable):
        c.get_json("u")
    c, _ = client([H.Answer(503, {}, b"")] * 99)
    for _ in range(H.BREAK_AFTER - 1):
        with pytest.raises(H.TransientError) as told:
            c.get_json("u")
        assert not isinstance(told.value, (H.NetworkUnavailable, H.CircuitOpen))
    for _ in range(2):
        with pytest.raises(H.CircuitOpen):
            c.get_json("u")
    c, clock = client([H.Answer(200, {"Content-Type": "text/html"}, b"<p>"), H.Answer(200, {"Content-Type": "application/json"}, b"{"), H.Answer(429, {"Retry-After": "soon"}, b""), ok([2])])
    assert c.get_json("u") == [2] and clock.slept[-1] == H.LONGEST
    c, _ = client([H.Answer(403, {}, b"")] * 9)
    with pytest.raises(H.TransientError):
        c.get_json("u")
    with pytest.raises(H.CircuitOpen):
        c.get_json("u")
    held = H.Cache(str(tmp_path / "old"))
    held.put("v", {"other": 1})
    with pytest.raises(H.ShapeError):
        client([], held)[0].get_json("v", validator=H.validate_history)
    cache = H.Cache(str(tmp_path), "map1")
    c, _ = client([ok([1]), ok([])], cache)
    assert c.get_json("slug=a") == c.get_json("slug=a") == [1]
    assert c.get_json("x", validator=H.validate_list) == [] and cache.get("x") is None
    assert H.Cache(str(tmp_path), "map2").get("slug=a") is None
    with pytest.raises(H.ShapeError):
        H.validate_history({"history": [{"t": 1}]})
    assert H.retry_after("Wed, 01 Jan 2025 00:00:10 GMT", dt.datetime(2025, 1, 1, tzinfo=dt.UTC).timestamp()) == 10.0 and H.retry_after("x", 0) is None


def test_recorded_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"url": f"u{i}", "body": {"n": i}}))
    spark.dataSource.register(H.RecordedSource)
    rows = spark.read.format("recorded").option("path", str(tmp_path)).load()
    assert sorted((r.url, json.loads(r.body)["n"]) for r in rows.collect()) == [("u0", 0), ("u1", 1), ("u2", 2)]


def test_schedules(spark):
    rows = spark.createDataFrame([("g1", "2025-01-01", "BOS @ NYK", "BOS", 90), ("g1", "2025-01-01", "NYK vs. BOS", "NYK", 101), ("g2", "2025-01-02", "BOS @ LAL", "BOS", 90)], "game_id string, et_date string, matchup string, team string, pts int")
    assert [(r.away, r.home, r.winner) for r in schedules.fold_team_rows(rows).collect()] == [("BOS", "NYK", "home")]
    week = {"gameWeek": [{"date": "2025-01-01", "games": [{"id": i, "gameType": t, "gameState": s, "startTimeUTC": "2025-01-01T00:00:00Z", "awayTeam": {"abbrev": "A", "score": 1}, "homeTeam": {"abbrev": "B", "score": h}} for i, t, s, h in ((1, 2, "OFF", 3), (1, 2, "OFF", 3), (2, 1, "OFF", 3), (3, 2, "LIVE", 3))]}]}
    bodies = spark.createDataFrame([(json.dumps(week),)], "body string")
    assert schedules.finished_games(bodies, 1).count() == 1
    with pytest.raises(ValueError):
        schedules.finished_games(bodies, 2)
    board = {"events": [{"id": "e", "date": "2025-01-02T00:30:00Z", "competitions": [{"neutralSite": True, "status": {"type": {"state": "pre"}}, "competitors": [{"homeAway": "home", "team": {"abbreviation": "NY"}}]}]}]}
    up = schedules.upcoming_games(spark.createDataFrame([(json.dumps(board),)], "body string")).first()
    assert (up.home, up.away, up.neutral_site, str(up.et_date)) == ("ny", None, True, "2025-01-01")
    markets = spark.createDataFrame([("nba-bos-nyk-2025-01-01", "Celtics", "Knicks"), ("nba-ny-bos-2025-01-02", "Knicks", "Celtics"), ("junk", "x", "y")], "slug string, away_label string, home_label string")
    assert {r.label: (r.abbr, r.conflict) for r in schedules.learned_abbreviations(markets).collect()} == {"celtics": ("bos", None), "knicks": (None, ["ny", "nyk"])}


def test_seal(spark, tmp_path):
    games = spark.createDataFrame([("nba", "24", "a", "home"), ("nba", "25", "b", "away")], f"{KEYS}, winner string")
    assert_dev_only(games.where("season = '24'"), "25")
    for bad in (games, games.withColumn("season", F.lit(None).cast("string"))):
        with pytest.raises(SealError):
            assert_dev_only(bad, "25")
    with pytest.raises(SealError):
        Seal(spark, f"file://{tmp_path}", "25", lambda: False, lambda: True).open(games, "me")
    seal = Seal(spark, f"file://{tmp_path}", "25", lambda: True, lambda: True)
    with pytest.raises(SealError):
        seal.assert_scorable(games)
    assert [r.y for r in seal.open(games, "me").collect()] == [0]
    seal.assert_scorable(games)
    with pytest.raises(SealError):
        seal.open(games, "me")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first().r


def test_scalars(spark):
    assert one(spark, S.aware_timestamp("x"), "2025-01-01T00:00:00") is None and one(spark, S.aware_timestamp("x"), "2025-01-01T00:00:00Z") is not None
    assert one(spark, S.season_to_code("x"), "2024-25") == "20242025" and one(spark, S.season_to_code("x"), "2024-26") is None and one(spark, S.season_to_code("x"), "1999-00") == "19992000"
    assert one(spark, S.season_of_code("x"), "20242025") == "2024-25"
    assert one(spark, S.parse_slug("x"), "nba-bos-nyk-2025-01-01").away == "bos" and one(spark, S.parse_slug("x"), "junk") is None
    assert one(spark, S.parse_matchup("x"), "NYK vs. BOS").away == "BOS"
    assert [one(spark, S.finite_or_null("x"), v) for v in ("1.5", "nan", "inf", "x", None)] == [1.5, None, None, None, None]
    assert [one(spark, S.is_probability("x"), v, "double") for v in (0.0, 1.0, 1.1, float("nan"), None)] == [True, True, False, False, False]
    assert one(spark, S.json_pair("x"), '["a","b"]') == ["a", "b"] and one(spark, S.json_pair("x"), '["a"]') is None and one(spark, S.json_pair("x"), "{") is None
    book = one(spark, S.parse_book("x"), json.dumps({"bids": [{"price": "0.4", "size": "1"}, {"price": "0.45", "size": "3"}], "asks": [{"price": "0.5", "size": "2"}, {"price": "0.47", "size": "4"}]}))
    assert (book.best_bid, book.best_ask, book.spread, book.bid_depth, book.ask_depth) == (0.45, 0.47, 0.02, 3.0, 4.0)
    assert one(spark, S.parse_book("x"), "{}").best_bid is None
    assert one(spark, S.expected_home(F.lit(1500), F.lit(1500), F.lit(0)), "") == 0.5
    assert one(spark, S.haversine_km(F.lit(42.366), F.lit(-71.062), F.lit(34.043), F.lit(-118.267)), "") == pytest.approx(4167, abs=15)
    with pytest.raises(Exception, match="margin"):
        one(spark, S.margin_multiplier(F.lit(0), F.lit(0)), "")
    assert one(spark, S.result_delay("x"), "other") == 9000 and one(spark, S.result_delay("x"), "nba") == 8400
    pair = lambda a, b: one(spark, S.resolution(F.lit(a), F.lit(b)), "")
    assert [pair(0.5, 0.5), pair(1.0, 0.0), pair(0.0, 1.0), pair(0.6, 0.6001), pair(None, 1.0)] == ["tie", "home", "away", "non_complementary", "malformed"]
    assert one(spark, S.in_poll_window(F.to_timestamp("x")), "2025-01-02 06:00:00") and not one(spark, S.in_poll_window(F.to_timestamp("x")), "2025-01-02 20:00:00")
    reason = lambda *a: one(spark, S.outcome_reason(*(F.lit(v) for v in a)), "")
    assert reason(True, True, False, True, 5, None, "home", "home") is None
    assert reason(False, True, True, True, 5, True, "home", "home") == "no_moneyline_market" and reason(False, False, False, True, 5, True, None, "home") == "no_market"
    assert reason(True, True, False, True, 5, False, "home", "home") == "complementarity_failed" and reason(True, True, False, True, 5, True, "away", "home") == "label_disagreement"
    assert one(spark, S.start_problem(F.to_timestamp("x"), F.lit("2025-01-01").cast("date")), "2025-01-02 00:30:00") is None
    assert one(spark, S.start_problem(F.to_timestamp("x"), F.lit("2025-01-02").cast("date")), "2025-01-02 05:57:00") == "odd_hour"
    assert one(spark, S.labels_match(F.array(F.lit("L.A. Lakers")), "x"), "lakers") and not one(spark, S.labels_match(F.array(F.lit("")), "x"), "lakers")
    assert one(spark, S.abbreviation_candidates("x", F.array(F.lit("Boston")), F.array(F.lit("bos"))), "BSN") == ["bos", "bsn", "bo", "bost"]
    bet = one(spark, S.settled_bet(F.lit(0.5), F.lit(0.6), F.lit(1), F.lit(0.01), F.lit(0.0)), "")
    assert (bet.paid, round(bet.profit, 6)) == (0.51, round(1 / 0.51 - 1, 6)) and one(spark, S.settled_bet(F.lit(0.5), F.lit(0.5), F.lit(1), F.lit(0.01), F.lit(0.0)), "") is None
    words = lambda parsed, start, told: one(spark, S.outcome_reason(*(F.lit(v) for v in (True, True, False, True, 5, True, "home", "home", parsed, start, told))), "")
    assert words(False, "2025-01-01T00:00:00Z", False) == "unparseable_market" and words(True, "2025-01-01T00:00:00Z", False) is None
    assert [words(True, x, False) for x in (None, " ", "soon", "2025-01-01 00:00:00")] == ["missing_gameStartTime"] * 2 + ["unparseable_gameStartTime"] * 2
    assert words(True, None, True) is None and words(True, "soon", True) is None
    # by hand: 0.4 + 0.02 + 0.05 * 0.4 * 0.6 = 0.432 is paid, so a win of one unit brings 1 / 0.432 - 1
    at = lambda won: one(spark, S.settled_bet(F.lit(0.4), F.lit(0.6), F.lit(won), F.lit(0.02), F.lit(0.05)), "")
    assert [(round(x.paid, 6), round(x.profit, 6)) for x in (at(1), at(0))] == [(0.432, 1.314815), (0.432, -1.0)]


def test_collector_hours():
    at = lambda h, m=0, d=1: dt.datetime(2025, 1, d, h, m, tzinfo=K.EASTERN)
    assert K.in_window(at(16)) and K.in_window(at(2, 30)) and not K.in_window(at(2, 31)) and not K.in_window(at(15, 59))
    assert K.window_start(None) == dt.time(16) and K.window_start(at(13)) == dt.time(10) and K.window_start(at(10)) == dt.time(9) and K.window_start(at(22)) == dt.time(16)
    assert K.minutes_until(at(15)) == 60 and K.minutes_until(at(17)) == 0
    season = [K.SeasonWindow("nba", "24", dt.date(2025, 1, 1), dt.date(2025, 1, 1))]
    assert K.active_seasons(at(23), season) and not K.active_seasons(at(1, 0, 2), season)
    assert K.silence_is_failure(0, at(17), season, 1, True) and K.silence_is_failure(0, at(17), season, 0, False)
    assert not K.silence_is_failure(1, at(17), season, 1, True) and not K.silence_is_failure(0, at(12), season, 1, True) and not K.silence_is_failure(0, at(17), season, 0, True)
    assert K.next_delay(310) == 290

    def broken(url):
        raise RuntimeError

    assert K.Heartbeat("u", broken).ping(True) is False and K.Heartbeat(None, broken).ping(True) is False


def test_stream_keeps_the_last_write(spark, tmp_path):
    raw = "sport string, season string, game_id string, token string, side string, captured_at timestamp, midpoint string, book string, start_time_utc timestamp, run_id string"
    at = dt.datetime(2025, 1, 1, 12)
    row = lambda token, mid, run: ("nba", "24", "g", token, "home", at, mid, None, None, run)
    folder = str(tmp_path / "in")
    for batch in ([row("a", "0.1", "1"), row("b", "nan", "1")], [row("a", "0.2", "2")]):
        spark.createDataFrame(batch, raw).write.mode("append").parquet(folder)
        K.start_collector(spark.readStream.schema(raw).parquet(folder), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    now = {r.token: r.midpoint for r in K.current(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert now == {"a": 0.2, "b": None}
    quotes = K.current(spark.read.parquet(str(tmp_path / "t")))
    assert K.captured_on(quotes).first().captured == 2 and K.coverage(quotes).first().quotes == 2


def test_streamed_ratings_are_those_of_the_batch(spark, tmp_path):
    schema = f"{KEYS}, start_t long, away string, home string, away_pts int, home_pts int, neutral_site boolean"
    rows = [("nba", "24", f"g{i:02}", i * 6000, "ab"[i % 2], "cd"[i // 2 % 2], 90 + i % 5, 97 - i % 3, i % 7 == 0) for i in range(30)]
    folder = str(tmp_path / "in")
    setting = {"nba": Setting(20, 50, 0.6)}
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = streaming_ratings(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), setting)
    stream.writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, ratings(spark.createDataFrame(rows, schema), setting).collect()))
