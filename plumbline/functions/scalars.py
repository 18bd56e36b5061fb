"""Column expressions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import RESULT_DELAY, START_HOURS

#: Fixed value: mean radius of the earth in km.
EARTH_KM = 6371.0088
#: Rating of a new team, and the margin's multiplier.
RATING_START, RATING_SCALE, MARGIN_ADD, MARGIN_POWER, MARGIN_BASE, MARGIN_EDGE = 1500.0, 400.0, 3.0, 0.8, 7.5, 0.006

Cols = Column | str


def col(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1: Cols, lon1: Cols, lat2: Cols, lon2: Cols) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def clipped(p: Cols, low: float, high: float) -> Column:
    return F.greatest(F.least(col(p), F.lit(high)), F.lit(low))


def logit(p: Cols, eps: float = 1e-6) -> Column:
    q = clipped(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def inv_logit(x: Cols) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def squared_error(p: Cols, y: Cols) -> Column:
    return F.pow(col(p) - col(y), 2)


def log_loss(p: Cols, y: Cols, low: float = 1e-15, high: float | None = None) -> Column:
    q = clipped(p, low, 1 - low if high is None else high)
    return -(col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))


def expected_home(home: Cols, away: Cols, bonus: Cols) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(col(home) + col(bonus) - col(away)) / RATING_SCALE))


def margin_multiplier(margin: Cols, winner_edge: Cols) -> Column:
    """Margins of 0 or less are refused."""
    sane = F.when(col(margin) > 0, col(margin)).otherwise(F.raise_error(F.lit("a decided game has a margin above 0")).cast("int"))
    return F.pow(sane + MARGIN_ADD, F.lit(MARGIN_POWER)) / (MARGIN_BASE + MARGIN_EDGE * col(winner_edge))


def carry_over(rating: Cols, share: float) -> Column:
    return RATING_START + share * (col(rating) - RATING_START)


def is_probability(p: Cols) -> Column:
    """A finite number from 0 to 1; false, not null, for anything else."""
    return F.coalesce(~F.isnan(col(p)) & col(p).between(0.0, 1.0), F.lit(False))


def finite_or_null(text: Cols) -> Column:
    """A number in text; null for what isn't one, and for NaN and infinities."""
    value = col(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)


def digits_only(text: Cols) -> Column:
    return F.coalesce(col(text).rlike("^[0-9]+$"), F.lit(False))


def aware_timestamp(text: Cols) -> Column:
    """ISO text with an offset or Z; text without one is null, for it would take on the session's zone."""
    return F.when(col(text).rlike(r"(Z|[+-]\d\d(:?\d\d)?)$"), F.try_to_timestamp(col(text)))


def winner_label(winner: Cols) -> Column:
    return F.when(col(winner) == "home", 1.0).otherwise(0.0)


def result_delay(sport: Cols, overrides: Mapping[str, int] | None = None) -> Column:
    """Seconds until a result is public; the longest of all for a sport that isn't listed."""
    delays = RESULT_DELAY | dict(overrides or {})
    out = F.lit(max(delays.values()))
    for name, seconds in delays.items():
        out = F.when(col(sport) == name, seconds).otherwise(out)
    return out.cast("long")


def season_to_code(label: Cols) -> Column:
    """``2024-25`` to ``20242025``; null for other text."""
    start = F.regexp_extract(col(label), r"^(\d{4})-(\d\d)$", 1)
    end = F.lpad(((start.try_cast("int") + 1) % 100).cast("string"), 2, "0")
    return F.when((start != "") & (F.right(col(label), F.lit(2)) == end), F.concat(start, (start.try_cast("int") + 1).cast("string")))


def season_of_code(code: Cols) -> Column:
    """``20242025`` to ``2024-25``."""
    return F.when(col(code).rlike(r"^\d{8}$"), F.concat(F.left(col(code), F.lit(4)), F.lit("-"), F.right(col(code), F.lit(2))))


def slug(sport: Cols, away: Cols, home: Cols, date: Cols) -> Column:
    return F.lower(F.concat_ws("-", col(sport), col(away), col(home), F.date_format(col(date), "yyyy-MM-dd")))


_SLUG = r"^([a-z]+)-([a-z0-9]+)-([a-z0-9]+)-(\d{4}-\d\d-\d\d)$"


def parse_slug(text: Cols) -> Column:
    """(sport, away, home, date) of a slug; null for other text."""
    part = lambda i: F.regexp_extract(col(text), _SLUG, i)
    return F.when(col(text).rlike(_SLUG), F.struct(part(1).alias("sport"), part(2).alias("away"), part(3).alias("home"), F.to_date(part(4)).alias("date")))


def parse_matchup(text: Cols) -> Column:
    """``AAA @ BBB`` (away at home) or ``AAA vs. BBB`` (home first): away and home."""
    at, versus = r"^([A-Z]+) @ ([A-Z]+)$", r"^([A-Z]+) vs\. ([A-Z]+)$"
    g = lambda rx, i: F.regexp_extract(col(text), rx, i)
    pair = lambda a, h: F.struct(a.alias("away"), h.alias("home"))
    return F.when(col(text).rlike(at), pair(g(at, 1), g(at, 2))).when(col(text).rlike(versus), pair(g(versus, 2), g(versus, 1)))


def normalised_label(text: Cols) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "")


def labels_match(labels: Cols, name: Cols) -> Column:
    """Does any label hold the other name, or the name it, once both are normalised?"""
    own = normalised_label(name)
    return F.exists(col(labels), lambda x: (normalised_label(x) != "") & (own != "") & (own.contains(normalised_label(x)) | normalised_label(x).contains(own)))


def abbreviation_candidates(scheduled: Cols, labels: Cols, priors: Cols) -> Column:
    """Candidates in order, each once: learned ones, the scheduled one, then the first 2, 3 and 4 letters of each label."""
    heads = F.flatten(F.transform(col(labels), lambda x: F.array(*(F.left(normalised_label(x), F.lit(n)) for n in (3, 2, 4)))))
    return F.filter(F.array_distinct(F.concat(col(priors), F.array(F.lower(col(scheduled))), heads)), lambda x: x.isNotNull() & (x != ""))


def json_pair(text: Cols) -> Column:
    """A JSON array of two strings, itself in text; null for any other shape."""
    found = F.from_json(col(text), "array<string>")
    return F.when(F.size(found) == 2, found)


def parse_book(text: Cols) -> Column:
    """Best bid (the highest), best ask (the lowest), spread, and the size at each, of an unsorted order book in JSON."""
    side = "array<struct<price:string,size:string>>"
    book = F.from_json(col(text), f"struct<bids:{side},asks:{side}>")
    prices = lambda xs: F.filter(F.transform(xs, lambda x: x["price"].try_cast("double")), lambda p: p.isNotNull())
    bid, ask = F.array_max(prices(book["bids"])), F.array_min(prices(book["asks"]))
    depth = lambda xs, best: F.aggregate(F.filter(xs, lambda x: x["price"].try_cast("double") == best), F.lit(0.0), lambda a, x: a + F.coalesce(x["size"].try_cast("double"), F.lit(0.0)))
    return F.struct(bid.alias("best_bid"), ask.alias("best_ask"), F.round(ask - bid, 6).alias("spread"), F.when(bid.isNotNull(), depth(book["bids"], bid)).alias("bid_depth"), F.when(ask.isNotNull(), depth(book["asks"], ask)).alias("ask_depth"))


def dedup_key(*parts: Cols) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def eastern(ts: Cols) -> Column:
    """A UTC timestamp as Eastern wall-clock time."""
    return F.from_utc_timestamp(col(ts), "America/New_York")


def start_problem(start: Cols, et_date: Cols) -> Column:
    """Why a start can't belong to a date: null if it can."""
    hour = F.hour(eastern(start))
    return F.when(col(start).isNull(), "no_start").when(F.to_date(eastern(start)) != col(et_date), "other_date").when(~hour.between(*START_HOURS), "odd_hour")


def in_poll_window(ts: Cols, opens: str = "16:00", closes: str = "02:30") -> Column:
    """Is the Eastern time of day in a window that may span midnight?"""
    minutes = F.hour(eastern(ts)) * 60 + F.minute(eastern(ts))
    low, high = (int(x[:2]) * 60 + int(x[3:]) for x in (opens, closes))
    return minutes.between(low, high) if low <= high else (minutes >= low) | (minutes <= high)


def first_of(chain: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(chain[0][0], F.lit(False)), chain[0][1])
    for condition, name in chain[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(F.lit(otherwise))


def resolution(home_price: Cols, away_price: Cols, tolerance: float = 1e-6) -> Column:
    """Who won by two settlement prices. A tie is looked for before the complement, which it would break."""
    h, a = col(home_price), col(away_price)
    return first_of([(h.isNull() | a.isNull(), "malformed"), (F.abs(h - a) <= 1e-9, "tie"), (F.abs(h + a - 1) >= tolerance, "non_complementary"), (h > a, "home")], "away")


def label_agreement(market: Cols, schedule: Cols) -> Column:
    return F.when(col(market).isNull() | ~col(market).isin("home", "away"), "unresolved").when(col(market) == col(schedule), "agree").otherwise("disagree")


def settled_bet(paid_side: Cols, fair: Cols, won: Cols, half_spread: Cols, fee: Cols) -> Column:
    """Price paid (price + half spread + fee) and profit of a bet of one unit; null where the fair price doesn't exceed what is paid.

    A bet that wins returns its unit 1 / paid times, one that loses none.
    """
    p = col(paid_side)
    paid = p + col(half_spread) + col(fee) * p * (1 - p)
    return F.when((col(fair) > paid) & (paid < 1), F.struct(paid.alias("paid"), F.when(col(won).cast("double") == 1, 1 / paid - 1).otherwise(-1.0).alias("profit")))


def outcome_reason(market: Cols, saw_events: Cols, partial_only: Cols, start_ok: Cols, points: Cols, complement_ok: Cols, resolved: Cols, schedule: Cols, parsed: Cols | None = None, start_text: Cols | None = None, cutoff_told: Cols | None = None) -> Column:
    """Why a game has no price, by the first rule that holds; null if it is priced. Unknown complementarity is no reason.

    ``parsed`` tells whether a market's two sides could be read, ``start_text`` is
    the start that a market names, which must be there and a time unless
    ``cutoff_told`` (the league has told its own). Rules whose columns aren't
    given are left out.
    """
    no = lambda c: ~F.coalesce(col(c), F.lit(False))
    agreement = label_agreement(resolved, schedule)
    starts = []
    if start_text is not None:
        needed = no(cutoff_told) if cutoff_told is not None else F.lit(True)
        told = F.trim(F.coalesce(col(start_text), F.lit(""))) != ""
        starts = [(needed & ~told, "missing_gameStartTime"), (needed & told & aware_timestamp(start_text).isNull(), "unparseable_gameStartTime")]
    return first_of([
        (no(market) & F.coalesce(col(partial_only), F.lit(False)), "no_moneyline_market"),
        (no(market) & F.coalesce(col(saw_events), F.lit(False)), "label_mismatch_at_slug"),
        (no(market), "no_market"),
        (no(start_ok), "implausible_game_start_time"),
        *([(no(parsed), "unparseable_market")] if parsed is not None else []),
        *starts,
        (F.coalesce(col(points), F.lit(0)) == 0, "no_pre_tipoff_points"),
        (~col(complement_ok), "complementarity_failed"),
        (col(resolved) == "tie", "postponed_or_split_resolution"),
        (col(resolved) == "non_complementary", "outcome_prices_not_complementary"),
        (col(resolved) == "malformed", "malformed_outcome_prices"),
        (agreement == "unresolved", "unresolved_market"),
        (agreement == "disagree", "label_disagreement"),
    ])


def moneyline(markets: Cols, wanted: str = "moneyline", partial: Sequence[str] = ()) -> Column:
    """Of an array of markets (structs with ``type``) the first of the wanted type; else the only one, unless it is of part of a game."""
    typed = F.filter(col(markets), lambda m: m["type"] == wanted)
    rest = F.filter(col(markets), lambda m: ~F.coalesce(m["type"].isin(list(partial)), F.lit(False)))
    return F.when(F.size(typed) > 0, F.element_at(typed, 1)).when((F.size(col(markets)) == 1) & (F.size(rest) == 1), F.element_at(rest, 1))
