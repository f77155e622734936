"""Schemas, column groups and constants shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# --------------------------------------------------------------------------
# Source tables
# --------------------------------------------------------------------------

PLAYS = _struct(
    season=_I, week=_I, play_type=_S, posteam=_S, defteam=_S,
    passer_player_id=_S, passer_player_name=_S,
    rusher_player_id=_S, rusher_player_name=_S,
    receiver_player_id=_S, receiver_player_name=_S,
    pass_attempt=_D, complete_pass=_D, rush_attempt=_D, yards_gained=_D,
    pass_touchdown=_D, rush_touchdown=_D, interception=_D, sack=_D,
    qb_dropback=_D, yardline_100=_D, air_yards=_D,
)

SCHEDULES = _struct(
    season=_I, week=_I, gameday=_S, home_team=_S, away_team=_S,
    spread_line=_D, total_line=_D, home_moneyline=_D, away_moneyline=_D,
    roof=_S, temp=_D, wind=_D, home_qb_id=_S, away_qb_id=_S,
)

SNAP_COUNTS = _struct(pfr_player_id=_S, season=_I, week=_I, offense_pct=_D)

INJURIES = _struct(gsis_id=_S, season=_I, week=_I, report_status=_S)

ROSTERS = _struct(
    player_id=_S, pfr_id=_S, position=_S, season=_I, team=_S, full_name=_S,
)

DEPTH_WEEKLY = _struct(
    gsis_id=_S, season=_I, week=_I, formation=_S, position=_S, depth_team=_S,
)

DEPTH_SNAPSHOTS = _struct(gsis_id=_S, dt=_S, pos_abb=_S, pos_rank=_I)

# --------------------------------------------------------------------------
# Gold table, by column group
# --------------------------------------------------------------------------

ID_COLUMNS = [
    "player_id", "player_name", "season", "week", "recent_team", "position",
    "opponent", "starting_qb_id", "gameday",
]
BOX_COLUMNS = [
    "pass_attempts", "completions", "passing_yards", "passing_tds",
    "interceptions", "rush_attempts", "rushing_yards", "rushing_tds",
    "targets", "receptions", "receiving_yards", "receiving_tds",
]
TARGET = "fantasy_points_ppr"
CONTEXT_COLUMNS = [
    "implied_total", "team_spread", "team_win_prob", "is_home", "temp", "wind",
    "is_bad_weather", "is_dome", "rest_advantage",
]
FORM_COLUMNS = [
    "fantasy_points_3wk_avg", "fantasy_points_5wk_avg", "rolling_games_count",
    "prev_season_ppg", "prev_season_games",
]
QB_COLUMNS = [
    "qb_pass_attempts_3wk_avg", "qb_pass_attempts_5wk_avg",
    "qb_rushing_yards_3wk_avg", "qb_rushing_yards_5wk_avg",
    "team_sack_rate_allowed", "opp_def_sack_rate",
]
RB_COLUMNS = [
    "player_opportunities", "team_total_opportunities", "opportunity_share",
    "hvt_carries", "hvt_targets", "total_hvts", "snap_share",
    "rb_opportunity_share_3wk_avg", "rb_opportunity_share_5wk_avg",
    "rb_hvts_3wk_avg", "rb_hvts_5wk_avg",
    "rb_snap_share_3wk_avg", "rb_snap_share_5wk_avg",
]
CATCHER_COLUMNS = [
    "team_pass_attempts", "target_share", "player_air_yards", "team_air_yards",
    "air_yards_share", "wopr", "starting_qb_aya",
    "wr_te_target_share_3wk_avg", "wr_te_target_share_5wk_avg",
    "wr_te_air_yards_share_3wk_avg", "wr_te_air_yards_share_5wk_avg",
    "wr_te_wopr_3wk_avg", "wr_te_wopr_5wk_avg",
]
MATCHUP_COLUMNS = [
    "opp_def_ppg_allowed", "opp_def_ypc_allowed", "opp_def_ypp_allowed",
    "wr1_wr2_healthy", "depth_chart_rank",
]
GOLD_COLUMNS = (
    ID_COLUMNS + BOX_COLUMNS + [TARGET] + CONTEXT_COLUMNS + FORM_COLUMNS
    + QB_COLUMNS + RB_COLUMNS + CATCHER_COLUMNS + MATCHUP_COLUMNS
)

_GOLD_STRINGS = {
    "player_id", "player_name", "recent_team", "position", "opponent",
    "starting_qb_id",
}
_GOLD_INTS = {
    "season", "week", "is_home", "is_bad_weather", "is_dome",
    "rolling_games_count", "wr1_wr2_healthy", "depth_chart_rank",
}


def _gold_type(name: str) -> T.DataType:
    if name in _GOLD_STRINGS:
        return _S
    if name in _GOLD_INTS:
        return _I
    return T.DateType() if name == "gameday" else _D


GOLD = T.StructType([T.StructField(c, _gold_type(c), True) for c in GOLD_COLUMNS])

# Columns whose NULLs become 0 in gold; is_home, is_bad_weather and
# rolling_games_count are left as they are.
GOLD_FILL_ZERO = [
    "fantasy_points_3wk_avg", "fantasy_points_5wk_avg",
    "prev_season_ppg", "prev_season_games",
    *QB_COLUMNS,
    *[c for c in RB_COLUMNS if c.endswith("_avg")], "snap_share",
    *[c for c in CATCHER_COLUMNS if c.endswith("_avg")], "starting_qb_aya",
    "opp_def_ppg_allowed", "opp_def_ypc_allowed", "opp_def_ypp_allowed",
    "implied_total", "team_spread", "team_win_prob", "temp", "wind",
    "rest_advantage", "is_dome", "depth_chart_rank",
]

# --------------------------------------------------------------------------
# Predictions table
# --------------------------------------------------------------------------

PREDICTION_CONTEXT = [
    "implied_total", "team_spread", "team_win_prob", "is_home", "temp", "wind",
    "is_bad_weather", "is_dome", "fantasy_points_3wk_avg", "depth_chart_rank",
    "opp_def_ppg_allowed", "prev_season_ppg",
]
PREDICTIONS = T.StructType([
    T.StructField("player_id", _S), T.StructField("player_name", _S),
    T.StructField("position", _S), T.StructField("recent_team", _S),
    T.StructField("opponent", _S), T.StructField("season", _I),
    T.StructField("week", _I), T.StructField("projected_ppr", _D),
    T.StructField("actual_ppr", _D),
    *[T.StructField(c, _I if c == "depth_chart_rank" else _D)
      for c in PREDICTION_CONTEXT],
    T.StructField("insight", _S), T.StructField("insight_source", _S),
])
INTEGER_SERVING_COLUMNS = [
    "season", "week", "depth_chart_rank", "wr1_wr2_healthy", "games_played",
    "first_season", "last_season", "total",
]

# --------------------------------------------------------------------------
# Fixed values of the semantics
# --------------------------------------------------------------------------

PREVIOUS_SEASON_WEIGHT = 0.3
WINDOWS = (3, 5)
HISTORY_SPAN = 3                  # history kept = span x window games
FANTASY_MAX_WEEK = 17
RED_ZONE = 10
BAD_WEATHER_WIND = 15
BAD_WEATHER_TEMP = 32
INDOOR_ROOFS = ["dome", "closed"]
DEFAULT_TOTAL = 44.0
DEFAULT_SPREAD = 0.0
DEFAULT_WIN_PROB = 0.5
NEUTRAL_TEMP, NEUTRAL_WIND = 72.0, 0.0
GOLD_UNLISTED_RANK = 9
SLATE_UNLISTED_RANK = 99
OUT_STATUSES = ["Out", "Doubtful"]
POSITIONS = ["QB", "RB", "WR", "TE"]
DEPTH_POSITIONS = ["QB", "RB", "WR", "TE", "FB"]
STARTER_ONLY_POSITIONS = ["QB", "TE"]
WEEKLY_DEPTH_LAST_SEASON = 2024   # weekly lists up to here, snapshots after
PAGE_DEFAULT, PAGE_MAX = 50, 700

# --------------------------------------------------------------------------
# Modelling column groups
# --------------------------------------------------------------------------

IDENTIFIER_COLUMNS = [
    "player_id", "player_name", "recent_team", "opponent", "starting_qb_id",
    "gameday",
]
SAME_WEEK_OUTCOMES = BOX_COLUMNS + [
    "player_opportunities", "team_total_opportunities", "opportunity_share",
    "hvt_carries", "hvt_targets", "total_hvts", "team_pass_attempts",
    "target_share", "player_air_yards", "team_air_yards", "air_yards_share",
    "wopr", "snap_share",
]
SHARED_FEATURES = [
    "season", "week", *CONTEXT_COLUMNS, "depth_chart_rank",
    "fantasy_points_3wk_avg", "fantasy_points_5wk_avg", "prev_season_ppg",
    "prev_season_games", "opp_def_ppg_allowed", "opp_def_ypp_allowed",
]
_CATCHER_FEATURES = [
    *[c for c in CATCHER_COLUMNS if c.endswith("_avg")], "starting_qb_aya",
    "opp_def_sack_rate",
]
POSITION_FEATURES = {
    "QB": [*[c for c in QB_COLUMNS if c.endswith("_avg")],
           "opp_def_sack_rate", "team_sack_rate_allowed", "wr1_wr2_healthy"],
    "RB": [*[c for c in RB_COLUMNS if c.endswith("_avg")],
           "opp_def_ypc_allowed"],
    "WR": [*_CATCHER_FEATURES, "wr1_wr2_healthy"],
    "TE": _CATCHER_FEATURES,
}
