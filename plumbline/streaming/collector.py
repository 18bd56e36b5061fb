"""Quotes as a stream: deduplicated by key with the last write standing, watched for silence."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.scalars import dedup_key, eastern, finite_or_null, parse_book
from plumbline.operators.outcomes import latest

EASTERN = ZoneInfo("America/New_York")
#: Seconds between polls, and of a session; earliest and latest Eastern time of a poll, and hours before the first game.
INTERVAL, SESSION = 300, 19_800
FLOOR, OPENS, CLOSES, LEAD_HOURS = dt.time(9, 0), dt.time(16, 0), dt.time(2, 30), 3


def quote_rows(raw: DataFrame) -> DataFrame:
    """Raw polls (sport, season, game_id, token, side, captured_at, midpoint text, book JSON, start_time_utc, run_id) as quotes."""
    book = parse_book("book")
    at = F.date_trunc("second", "captured_at")
    return raw.select(
        dedup_key("sport", "season", "token", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("dedup_key"), "sport", "season", "game_id", "token", "side", at.alias("captured_at"),
        finite_or_null("midpoint").alias("midpoint"), book["best_bid"].alias("best_bid"), book["best_ask"].alias("best_ask"), book["spread"].alias("spread"), "start_time_utc", "run_id",
        (F.unix_timestamp("start_time_utc") - F.unix_timestamp(at)).alias("secs_to_start"),
    )


def upsert(table: str) -> Callable[[DataFrame, int], None]:
    """A batch writer whose table holds, for each key, the row of the last batch that had it. A batch that comes again writes the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        one = latest(batch, ["dedup_key"], ["captured_at", "run_id"])
        one.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return write


def current(log: DataFrame) -> DataFrame:
    """The table as readers see it: the last batch of each key."""
    return latest(log, ["dedup_key"], ["batch", "captured_at"]).drop("batch", "batch_id")


def start_collector(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of raw polls; ``once`` takes what is there and ends."""
    writer = quote_rows(stream).writeStream.foreachBatch(upsert(table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{INTERVAL} seconds")).start()


def coverage(quotes: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Quotes and games by sport and window of event time; for streams late rows fall off behind the watermark."""
    return quotes.withWatermark("captured_at", delay).groupBy("sport", F.window("captured_at", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("quotes"), F.approx_count_distinct("game_id").alias("games"))


def captured_on(quotes: DataFrame) -> DataFrame:
    """Quotes by Eastern date."""
    return quotes.groupBy(F.to_date(eastern("captured_at")).alias("et_date")).agg(F.count(F.lit(1)).alias("captured"))


def upcoming_targets(games: DataFrame, now: int, lookahead_hours: int = 8, grace_minutes: int = 30) -> DataFrame:
    """Games that begin soon or have just begun; a game without a start is a target."""
    ahead = F.col("start_t") - now
    return games.where(F.col("start_t").isNull() | ahead.between(-60 * grace_minutes, 3600 * lookahead_hours))


class SeasonWindow(NamedTuple):
    sport: str
    season: str
    first: dt.date
    last: dt.date


def active_seasons(now: dt.datetime, windows: list[SeasonWindow]) -> list[SeasonWindow]:
    day = now.astimezone(EASTERN).date()
    return [w for w in windows if w.first <= day <= w.last]


def window_start(first_start: dt.datetime | None) -> dt.time:
    """When polling opens: earlier on a day that has an early game, but not before the floor."""
    if first_start is None:
        return OPENS
    local = first_start.astimezone(EASTERN)
    lead = (dt.datetime.combine(local.date(), local.time()) - dt.timedelta(hours=LEAD_HOURS)).time() if local.hour >= LEAD_HOURS else FLOOR
    return max(FLOOR, min(OPENS, lead))


def in_window(now: dt.datetime, opens: dt.time = OPENS) -> bool:
    local = now.astimezone(EASTERN).time()
    return local >= opens or local <= CLOSES


def minutes_until(now: dt.datetime, opens: dt.time = OPENS) -> float:
    """Minutes until the window opens, over a change of clocks too; 0 inside it."""
    if in_window(now, opens):
        return 0.0
    local = now.astimezone(EASTERN)
    target = dt.datetime.combine(local.date(), opens, EASTERN)
    return (target.astimezone(dt.UTC) - now.astimezone(dt.UTC)).total_seconds() / 60


def next_delay(elapsed: float, interval: float = INTERVAL) -> float:
    """Seconds to the next poll on a grid from the session's start, so that slow polls don't shift the rest."""
    return interval - elapsed % interval


def silence_is_failure(captured: int, now: dt.datetime, windows: list[SeasonWindow], due: int, listed: bool, opens: dt.time = OPENS) -> bool:
    """No quote at all is a failure in a season and its hours, if games were due or couldn't even be listed."""
    return captured == 0 and bool(active_seasons(now, windows)) and in_window(now, opens) and (due > 0 or not listed)


class Heartbeat:
    """Tells a monitor how a run went. A monitor that can't be reached never breaks a run."""

    def __init__(self, url: str | None, send: Callable[[str], None]):
        self.url, self.send = url, send

    def ping(self, ok: bool) -> bool:
        if not self.url:
            return False
        try:
            self.send(self.url if ok else f"{self.url.rstrip('/')}/fail")
        except Exception:  # noqa: BLE001 - whatever the transport raises
            return False
        return True


def poll_sequence(quotes: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """Each quote with the number of its poll in its game's session."""
    first = F.min(F.unix_timestamp("captured_at")).over(Window.partitionBy("sport", "season", "game_id"))
    return quotes.withColumn("poll_seq", F.floor((F.unix_timestamp("captured_at") - first) / interval).cast("long"))
