"""Logical schemas, as DDL, and values that are fixed by the data they describe."""

GAMES = "sport string, season string, game_id string, et_date date, away string, home string, away_pts int, home_pts int, winner string, neutral_site boolean, start_time_utc timestamp, run_id string"
QUOTES = "sport string, season string, game_id string, side string, t bigint, p double, run_id string"
MISSES = "sport string, season string, game_id string, reason string, attempted string, detail string, run_id string"
VOLUME_PATCH = "sport string, season string, game_id string, slug string, et_date date, volume_recovered double, volume_source string, from_census_cache boolean, note string"
ANCHORS = "sport string, season string, game_id string, side string, horizon string, horizon_secs bigint, tip_t bigint, n_pre_tipoff bigint, quote_t bigint, p double, secs_before_tip bigint"
TARGETS = "sport string, season string, game_id string, et_date date, away string, home string, neutral_site boolean, as_of bigint"
VENUES = "sport string, team string, lat double, lon double, city string, tz_offset_std double"
LIVE_QUOTES = "dedup_key string, sport string, season string, game_id string, token string, side string, captured_at timestamp, midpoint double, best_bid double, best_ask double, spread double, start_time_utc timestamp, run_id string"
RUNS = "run_id string, started_at timestamp, finished_at timestamp, manifest string"
META = "k string, v string"

#: Seconds before the start at which a price is read, by name.
HORIZONS = {"close": 0, "t1h": 3600, "t6h": 21600, "t24h": 86400}
#: Seconds after a start at which its result is public; an unknown sport waits the longest.
RESULT_DELAY = {"nba": 8400, "nhl": 9000}
DENSITY_SECONDS = 7 * 86400
#: Bounds and tolerances.
STALE_RUN, PAIR_GAP, PAIR_WINDOW, PAIR_TOLERANCE, PAIR_MINIMUM, PAIR_SHARE = 10, 60, 7200, 1e-6, 10, 0.5
TIE_TOLERANCE, LIVE_TOLERANCE = 1e-9, 0.02
BIN_MINIMUM, BIN_MAXIMUM = 150, 10
#: Tiers of |model - market|, closed below and open above; below the first there is none.
RISK_TIERS = (("T1", 0.02, 0.05), ("T2", 0.05, 0.10), ("T3", 0.10, float("inf")))
#: Hours of Eastern time in which a game can begin.
START_HOURS = (11, 23)
#: Why a scheduled game has no price; nothing else is a reason.
MISS_REASONS = (
    "no_market",
    "no_pre_tipoff_points",
    "unparseable_market",
    "missing_gameStartTime",
    "unparseable_gameStartTime",
    "postponed_or_split_resolution",
    "outcome_prices_not_complementary",
    "malformed_outcome_prices",
    "complementarity_failed",
    "label_mismatch_at_slug",
    "implausible_game_start_time",
    "no_moneyline_market",
    "unresolved_market",
    "label_disagreement",
)
#: The type of the market that is asked for, and types that are of part of a game.
MONEYLINE = "moneyline"
PARTIAL_MARKETS = ("spreads", "first_half_moneyline", "first_half_spreads", "first_half_totals")
#: Bounds of the gate on the pooled prices.
GATE_ECE, GATE_MAX_BIN, GATE_SLOPE, GATE_INTERCEPT = 0.03, 0.08, (0.91, 1.10), (-0.07, 0.07)
#: By sport and n, the 99 % point of ECE and the 95 % interval of the slope of true prices.
NULL_TABLE = (
    ("nba", 200, 0.1299, 0.696, 1.417),
    ("nba", 300, 0.0991, 0.760, 1.319),
    ("nba", 613, 0.0733, 0.817, 1.220),
    ("nba", 1226, 0.0515, 0.868, 1.154),
    ("nba", 2455, 0.0355, 0.902, 1.100),
    ("nhl", 200, 0.1414, 0.382, 1.767),
    ("nhl", 225, 0.1288, 0.414, 1.694),
    ("nhl", 300, 0.1118, 0.470, 1.605),
    ("nhl", 448, 0.0938, 0.541, 1.464),
    ("nhl", 615, 0.0775, 0.626, 1.410),
    ("nhl", 896, 0.0655, 0.687, 1.326),
    ("nhl", 1310, 0.0553, 0.740, 1.267),
    ("nhl", 2206, 0.0416, 0.806, 1.207),
)
#: Points of the rating grids (step, home bonus, carried share) and the settings chosen on them.
RATING_GRIDS = {
    "nba": ((10, 15, 20, 25, 30), (50, 75, 100, 125), (0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)),
    "nhl": ((8, 12, 16, 20, 30), (25, 50, 75), (0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)),
}
RATING_SETTINGS = {"nba": (20, 50, 0.6), "nhl": (16, 50, 0.9)}
#: Edges of the reliability buckets, and price bands of the sensitivity.
BUCKET_EDGES = (0.0, 0.35, 0.45, 0.55, 0.65, 1.0)
PRICE_BANDS = ((0.20, 0.80), (0.35, 0.65))
#: Half spreads and fee rates of the cost grid, and the cell that decides.
COST_GRID = ((0.01, 0.0), (0.01, 0.05), (0.02, 0.0), (0.02, 0.05), (0.03, 0.0), (0.03, 0.05))
DECIDING_COST = (0.02, 0.05)
#: Pools and sizes whose null bands are derived.
NULL_SIZES = (
    *(("nba", n) for n in (200, 300, 613, 1226, 2455)),
    *(("nhl", n) for n in (200, 225, 300, 448, 615, 896, 1310, 2206)),
    ("all", 4661),
)
