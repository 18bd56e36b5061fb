"""From schedules, events and ticks to outcomes: resolving games to markets, reading their prices, telling why one has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import abbreviation_candidates, digits_only, json_pair, labels_match, moneyline, outcome_reason, parse_slug, resolution, slug, start_problem
from plumbline.operators.anchors import anchors_wide
from plumbline.operators.outcomes import KEY, one_of, rematches, slice_games
from plumbline.operators.series import complementarity, stale_flat_run
from plumbline.schemas import MONEYLINE, PARTIAL_MARKETS

#: Reasons that a later look may undo.
RETRYABLE = ("no_market", "no_pre_tipoff_points", "label_mismatch_at_slug", "unresolved_market", "no_moneyline_market", "missing_gameStartTime", "unparseable_market")


def slug_candidates(games: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Slugs under which a game may be listed, in order: its date and the next day, except the day of a rematch, by every abbreviation of both teams.

    ``abbreviations`` has sport, team, labels (array) and priors (array).
    """
    names = abbreviations.select("sport", "team", "labels", abbreviation_candidates("team", "labels", "priors").alias("abbr"))
    side = lambda s: names.select("sport", F.col("team").alias(s), F.col("labels").alias(f"{s}_labels"), F.posexplode("abbr").alias(f"{s}_n", f"{s}_abbr"))
    again = rematches(games).select(*KEY).withColumn("__again", F.lit(True))
    rows = games.join(side("away"), ["sport", "away"]).join(side("home"), ["sport", "home"]).join(again, list(KEY), "left")
    days = F.when(F.col("__again"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    held = rows.select(*KEY, "away_labels", "home_labels", "away_n", "home_n", "away_abbr", "home_abbr", "et_date", F.explode(days).alias("day"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("day", F.col("away_n") + F.col("home_n"), "away_n"))
    return held.select(*KEY, "away_labels", "home_labels", slug("sport", "away_abbr", "home_abbr", F.expr("date_add(et_date, day)")).alias("slug"), place.alias("place")).dropDuplicates([*KEY, "slug"])


def confirm(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The first candidate whose event has a market of these teams; why none is, else.

    ``events`` has slug and markets: an array of structs (type, away_label,
    home_label, token). A game is ``found`` with slug and market, or has seen
    events, or only markets of part of a game.
    """
    met = candidates.join(events, "slug", "left")
    fits = F.filter("markets", lambda m: labels_match("away_labels", m["away_label"]) & labels_match("home_labels", m["home_label"]))
    told = met.withColumn("fitting", fits).withColumn("market", moneyline("fitting", MONEYLINE, PARTIAL_MARKETS))
    hit = F.col("market").isNotNull()
    return told.groupBy(*KEY).agg(
        F.min(F.when(hit, F.struct("place", "slug", "market"))).alias("hit"),
        F.max(F.col("markets").isNotNull()).alias("saw_events"),
        F.max(F.coalesce(F.size("fitting") > 0, F.lit(False)) & ~hit).alias("partial_only"),
        F.sort_array(F.collect_set("slug")).alias("attempted"),
    ).select(*KEY, F.col("hit.slug").alias("slug"), F.col("hit.market").alias("market"), "saw_events", "partial_only", "attempted")


def learned_priors(confirmed: DataFrame, games: DataFrame) -> DataFrame:
    """By team, the abbreviation that most of its found slugs use; two that are as frequent teach nothing."""
    told = confirmed.where("slug is not null").join(games.select(*KEY, "away", "home"), list(KEY)).withColumn("s", parse_slug("slug"))
    pairs = told.select("sport", F.inline(F.array(F.struct(F.col("away").alias("team"), F.col("s.away").alias("abbr")), F.struct(F.col("home").alias("team"), F.col("s.home").alias("abbr")))))
    counts = pairs.groupBy("sport", "team", "abbr").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("top", F.max("n").over(Window.partitionBy("sport", "team"))).where("n = top")
    return best.groupBy("sport", "team").agg(F.min("abbr").alias("learned"), F.count(F.lit(1)).alias("ties")).where("ties = 1").select("sport", "team", "learned")


def resolve(games: DataFrame, teams: DataFrame, events: DataFrame, first: int = 20) -> DataFrame:
    """Confirms games in two passes: the first games of each sport and season teach the abbreviations that the rest are looked up by.

    A game that its team's learned abbreviation doesn't find is tried by all others too.
    """
    probes = slice_games(games, first, "stride")
    taught = learned_priors(confirm(slug_candidates(probes, teams), events), games)
    ahead = teams.join(taught, ["sport", "team"], "left").withColumn("priors", F.array_compact(F.concat(F.array("learned"), "priors"))).drop("learned")
    return confirm(slug_candidates(games, ahead), events)


def closing(quotes: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per game: prices of the home side at all horizons, points, staleness and complementarity.

    ``quotes`` are ticks of sides ``home`` and ``away``; ``starts`` has tip_t.
    """
    home = quotes.where("side = 'home'")
    wide = anchors_wide(home, starts).drop("side")
    before = home.join(starts.select(*KEY, "tip_t"), list(KEY)).where("t <= tip_t")
    stale = stale_flat_run(before, KEY)
    sums = complementarity(before.drop("side"), quotes.where("side = 'away'").drop("side"), KEY)
    return wide.join(stale, list(KEY), "left").join(sums, list(KEY), "left").withColumn("secs_before_tip", F.col("tip_t") - F.col("t_close"))


def classify(confirmed: DataFrame, closes: DataFrame, settlements: DataFrame, games: DataFrame, starts: DataFrame | None = None, markets: DataFrame | None = None) -> DataFrame:
    """Every game with its closing prices and ``reason``: null if it is priced, else the first rule that speaks against it.

    ``settlements`` has home_settled and away_settled, the prices a market ended at;
    ``starts`` has market_start, the time (a timestamp) at which a market says that
    its game begins, which must lie on the game's date at an hour of play. Without
    that table starts aren't checked. ``markets`` has a market's own words: the
    texts of its pairs of tokens (``token_pair``) and names (``outcome_pair``),
    ``start_text``, and ``league_start`` (a timestamp); without it they are taken as sound.
    """
    dated = games.select(*KEY, "winner", *(["et_date"] if starts is not None else []))
    start_ok = F.lit(True)
    if starts is not None:
        dated = dated.join(starts.select(*KEY, "market_start"), list(KEY), "left")
        start_ok = start_problem("market_start", "et_date").isNull()
    told: tuple = ()
    if markets is not None:
        tokens = json_pair("token_pair")
        parsed = tokens.isNotNull() & json_pair("outcome_pair").isNotNull() & digits_only(tokens[0]) & digits_only(tokens[1])
        own = markets.select(*KEY, parsed.alias("__parsed"), F.col("start_text").alias("__start"), F.col("league_start").isNotNull().alias("__told"))
        dated, told = dated.join(own, list(KEY), "left"), ("__parsed", "__start", "__told")
    rows = dated.withColumn("start_ok", start_ok).drop("et_date", "market_start").join(confirmed, list(KEY), "left").join(closes, list(KEY), "left").join(settlements, list(KEY), "left")
    resolved = F.when(F.col("home_settled").isNull() & F.col("away_settled").isNull(), F.lit(None)).otherwise(resolution("home_settled", "away_settled"))
    out = rows.withColumn("market_winner", resolved)
    reason = outcome_reason(F.col("slug").isNotNull(), "saw_events", "partial_only", "start_ok", "n_pre_tipoff", "complement_ok", "market_winner", "winner", *told)
    return out.withColumn("reason", reason).drop("start_ok", *told)


def to_reprobe(misses: DataFrame, reasons: Sequence[str] = RETRYABLE) -> DataFrame:
    return one_of(misses, "reason", reasons)


def first_blind(log: DataFrame) -> DataFrame:
    """Of each game's forecasts the first that was made blind."""
    own = F.row_number().over(Window.partitionBy("game_id").orderBy("logged_at"))
    return log.where("blind").withColumn("__n", own).where("__n = 1").drop("__n")


def slate_forecast(finals: DataFrame, slate: DataFrame, bonus: float) -> DataFrame:
    """Home win probability of games to come from final ratings; a team without rating has that of a new one."""
    from plumbline.functions.scalars import RATING_START, expected_home

    of = lambda s: finals.select("sport", F.col("team").alias(s), F.col("rating").alias(f"r_{s}"))
    rows = slate.join(of("away"), ["sport", "away"], "left").join(of("home"), ["sport", "home"], "left").fillna(RATING_START, ["r_away", "r_home"])
    edge = F.when(F.coalesce("neutral_site", F.lit(False)), 0.0).otherwise(bonus)
    return rows.withColumn("p_home", expected_home("r_home", "r_away", edge)).withColumn("lean", F.when(F.col("p_home") >= 0.5, "home").otherwise("away"))
