"""Sources, sinks, projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.suite import GOLD_DOUBLES, PREDICTION_DOUBLES, Domain, add, registered
from checks.tables_sql import TEMPLATE
from weekcast import schema
from weekcast.functions import labels as L
from weekcast.functions import scoring as S
from weekcast.plans import boxscore as B
from weekcast.plans import context as C
from weekcast.plans import evaluation as E
from weekcast.plans import features as FT
from weekcast.plans import insight as I
from weekcast.plans import serving as Q
from weekcast.plans.weekly import weekly_run
from weekcast.session import new_path
from weekcast.sources import catalog, sinks, tables

c = F.col
PICK = "player_id player_name season week recent_team position opponent fantasy_points_ppr".split()
PICKED = ", ".join(PICK)


def source(d: Domain, name: str, seasons=None):
    return tables.read_source(d.spark, d.source_folder(name), name, seasons)


# --- scans -----------------------------------------------------------------

add("s1_read_plays", lambda d: source(d, "plays", [2000, 2001]).groupBy(
    "season", "week", "play_type").agg(
    F.count(F.lit(1)).alias("plays"), F.sum("yards_gained").alias("yards")),
    """SELECT season, week, play_type, count(*) AS plays, sum(yards_gained) AS yards
       FROM plays WHERE season IN (2000, 2001) GROUP BY ALL""", "yards")
add("s2_read_schedules", lambda d: source(d, "schedules"), "SELECT * FROM schedules",
    "spread_line total_line home_moneyline away_moneyline temp wind")
add("s3_read_snap_counts", lambda d: source(d, "snap_counts"), "SELECT * FROM snap_counts",
    "offense_pct")
add("s4_read_injuries", lambda d: source(d, "injuries"), "SELECT * FROM injuries")
add("s5_read_rosters", lambda d: source(d, "rosters"), "SELECT * FROM rosters")


def _depth_eras(d: Domain):
    weekly, snapshots = tables.read_depth_charts(
        d.spark, d.source_folder("depth_weekly", "depth_snapshots"))
    count = F.count(F.lit(1)).alias("listings")
    return weekly.groupBy("gsis_id", F.lit("weekly").alias("era")).agg(count).unionByName(
        snapshots.groupBy("gsis_id", F.lit("snapshot").alias("era")).agg(count))


add("s6_read_depth_charts", _depth_eras,
    """SELECT gsis_id, 'weekly' AS era, count(*) AS listings FROM depth_weekly GROUP BY gsis_id
       UNION ALL
       SELECT gsis_id, 'snapshot', count(*) FROM depth_snapshots GROUP BY gsis_id""")
add("s7_read_gold", lambda d: d.gold.select(*schema.GOLD_COLUMNS), "SELECT * FROM gold",
    GOLD_DOUBLES)
add("s7_gold_table", lambda d: d.table("gold").where("season = 2001").select(
    *schema.GOLD_COLUMNS), "SELECT * FROM gold WHERE season = 2001", GOLD_DOUBLES)
add("s8_read_predictions", lambda d: d.predictions,
    "SELECT * FROM predictions", PREDICTION_DOUBLES)
add("s8_predictions_table", lambda d: d.table("predictions"),
    "SELECT * FROM predictions", PREDICTION_DOUBLES)

# --- sinks -----------------------------------------------------------------


def _rebuilt(d: Domain):
    path = new_path(d.spark, "rebuild")
    sinks.rebuild(d.gold.select(*PICK, "wopr"), path)
    sinks.rebuild(d.gold.select(*PICK), path)          # the second schema wins
    return d.spark.read.parquet(path).select(*PICK)


add("s9_rebuild_table", _rebuilt, f"SELECT {PICKED} FROM gold", "fantasy_points_ppr")


def _slice_replaced(d: Domain):
    path = new_path(d.spark, "slices")
    sinks.rebuild(d.gold.select(*PICK), path)
    fresh = d.gold.select(*PICK).where((c("season") == 2000) & (c("week") == 5)).withColumn(
        "fantasy_points_ppr", c("fantasy_points_ppr") + 100)
    sinks.replace_slice(fresh, path, 2000, 5)
    return d.spark.read.parquet(path).select(*PICK)


add("s10_replace_slice", _slice_replaced, f"""
    SELECT * REPLACE (fantasy_points_ppr
      + CASE WHEN season = 2000 AND week = 5 THEN 100 ELSE 0 END AS fantasy_points_ppr)
    FROM (SELECT {PICKED} FROM gold)""", "fantasy_points_ppr")


def _slice_emptied(d: Domain):
    """A table's slice replaced by no rows, and another by a change of its own rows."""
    path = new_path(d.spark, "slices")
    sinks.rebuild(d.gold.select(*PICK), path)
    name = registered(d.spark, path, d.gold.select(*PICK).schema)
    table = d.spark.table(name)
    catalog.replace_slice(table.where("season = 2000 AND week = 5 AND player_id = 'none'"),
                          name, 2000, 5)
    mine = d.spark.table(name).where("season = 2000 AND week = 4")
    catalog.replace_slice(mine.withColumn(
        "fantasy_points_ppr", c("fantasy_points_ppr") - 100), name, 2000, 4)
    return d.spark.table(name).select(*PICK)


add("s10_empty_and_own_slice", _slice_emptied, f"""
    SELECT * REPLACE (fantasy_points_ppr
      - CASE WHEN season = 2000 AND week = 4 THEN 100 ELSE 0 END AS fantasy_points_ppr)
    FROM (SELECT {PICKED} FROM gold) WHERE season <> 2000 OR week <> 5""", "fantasy_points_ppr")


def _evolved_on_write(d: Domain):
    """Old slices on disk without text; the newest is written with two more columns."""
    path = new_path(d.spark, "evolving")
    sinks.rebuild(I.without_insights(d.predictions), path)
    name = registered(d.spark, path, I.without_insights(d.predictions).schema)
    season, week = d.newest("predictions")
    newest = d.predictions.where((c("season") == season) & (c("week") == week))
    catalog.replace_slice(newest, name, season, week)
    columns = ["player_id", "season", "week", "projected_ppr", "insight", "insight_source"]
    merged = sinks.merged_history(d.spark, path).select(*columns)
    return merged.withColumn("read_as", F.lit("files")).unionByName(
        d.spark.table(name).select(*columns, F.lit("table").alias("read_as")))


add("s11_evolve_on_write", _evolved_on_write, """
    SELECT player_id, season, week, projected_ppr,
      CASE WHEN actual_ppr IS NULL THEN insight END AS insight,
      CASE WHEN actual_ppr IS NULL THEN insight_source END AS insight_source,
      unnest(['files', 'table']) AS read_as
    FROM predictions""", "projected_ppr")


def _evolved(d: Domain):
    old = I.without_insights(d.predictions).where(c("actual_ppr").isNotNull())
    return sinks.evolve(old, d.predictions.where(c("actual_ppr").isNull())).select(
        "player_id", "season", "week", "projected_ppr", "insight", "insight_source")


add("s11_evolve_schema", _evolved, """
    SELECT player_id, season, week, projected_ppr,
      CASE WHEN actual_ppr IS NULL THEN insight END AS insight,
      CASE WHEN actual_ppr IS NULL THEN insight_source END AS insight_source
    FROM predictions""", "projected_ppr")
add("s12_conform_schema", lambda d: sinks.conform(
    d.gold.withColumn("missing_vegas_lines", F.lit(0)), schema.PREDICTIONS),
    "SELECT {} FROM gold".format(", ".join(
        ("CAST({} AS {}) AS {}".format(
            f.name if f.name in schema.GOLD_COLUMNS else "NULL",
            {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}[f.dataType.simpleString()],
            f.name)) for f in schema.PREDICTIONS.fields)), PREDICTION_DOUBLES)
add("s13_slice_gate", lambda d: sinks.slice_counts(d.gold).withColumn(
    "required_rows", F.lit(sinks.require_slice(d.gold, 2001, 1))),
    """SELECT season, week, count(*) AS row_count, CAST((SELECT count(*) FROM gold
         WHERE season = 2001 AND week = 1) AS INTEGER) AS required_rows
       FROM gold GROUP BY season, week""")

# --- projections and filters -------------------------------------------------

add("p1_play_type_filter", lambda d: d.star.plays(
    ["season", "week", "play_type", "yards_gained"]).where(
    c("play_type").isin("pass", "run")),
    "SELECT season, week, play_type, yards_gained FROM plays WHERE play_type IN ('pass', 'run')",
    "yards_gained")
add("p2_role_known_filter", lambda d: d.star.plays(
    ["season", "week", "passer_player_id", "posteam"]).where(
    c("passer_player_id").isNotNull()),
    "SELECT season, week, posteam, passer_player_id FROM plays WHERE passer_player_id IS NOT NULL")
add("p3_membership", lambda d: d.star.rosters.where(c("position").isin(schema.POSITIONS)),
    "SELECT * FROM rosters WHERE position IN ('QB', 'RB', 'WR', 'TE')")
add("p4_season_scope", lambda d: tables.fantasy_weeks(d.gold, 9).select(*PICK),
    f"SELECT {PICKED} FROM gold WHERE week <= 9", "fantasy_points_ppr")
add("p5_rename_project", lambda d: B.passer_box(d.box_plays).select(
    c("player_id").alias("passer"), c("pass_attempts").alias("attempts"), "season", "week"),
    "SELECT player_id AS passer, pass_attempts AS attempts, season, week FROM pass_box",
    "attempts")
add("p6_constant_tags", lambda d: C.team_games(d.star.schedules).select(
    "season", "week", "team", "is_home"),
    "SELECT season, week, team, is_home FROM team_games")
add("p7_leakage_guard", lambda d: E.leakage_guard(d.gold),
    "SELECT * EXCLUDE ({}) FROM gold".format(
        ", ".join(schema.IDENTIFIER_COLUMNS + schema.SAME_WEEK_OUTCOMES)),
    " ".join(x for x in GOLD_DOUBLES.split() if x not in schema.SAME_WEEK_OUTCOMES))
add("p8_weather_flags", lambda d: C.game_context(d.star.schedules).select(
    "season", "week", "team", "is_dome", "is_bad_weather"),
    "SELECT season, week, team, is_dome, is_bad_weather FROM games")
add("p9_position_mask", lambda d: d.unfiltered_gold.select(
    "player_id", "season", "week",
    F.when(c("position") == "RB", c("snap_share")).alias("rb_snap_share")),
    """SELECT player_id, season, week, CASE WHEN position = 'RB' THEN snap_share END
         AS rb_snap_share FROM gold_all""", "rb_snap_share")
add("p10_fill_zero", lambda d: C.game_context(d.star.schedules).select(
    "season", "week", "team", "temp", "team_spread", "implied_total").fillna(0),
    """SELECT season, week, team, coalesce(temp, 0) AS temp,
         coalesce(team_spread, 0) AS team_spread, coalesce(implied_total, 0) AS implied_total
       FROM games""", "temp team_spread implied_total")
add("p11_coalesce", lambda d: FT.weekly_ranks(d.star.depth_weekly).select(
    "player_id", "season", "week",
    F.coalesce("rank_weekly", F.lit(schema.GOLD_UNLISTED_RANK)).alias("rank")),
    "SELECT player_id, season, week, coalesce(rank_weekly, 9) AS rank FROM weekly_rank")
add("p12_position_remap", lambda d: d.star.rosters.select(
    "player_id", "season", S.roster_position("position").alias("role"),
    S.known_position("position").alias("shown")),
    """SELECT player_id, season,
         CASE WHEN position = 'FB' THEN 'RB' WHEN position <> 'K' THEN position END AS role,
         CASE WHEN position IN ('QB', 'RB', 'WR', 'TE') THEN position ELSE 'WR' END AS shown
       FROM rosters""")
add("p13_line_defaults", lambda d: C.team_games(d.star.schedules).select(
    "season", "week", "team",
    F.coalesce("total_line", F.lit(schema.DEFAULT_TOTAL)).alias("total_line"),
    F.coalesce("team_spread", F.lit(schema.DEFAULT_SPREAD)).alias("team_spread")),
    """SELECT g.season, g.week, team, coalesce(total_line, 44.0) AS total_line,
         coalesce(team_spread, 0) AS team_spread
       FROM team_games g JOIN schedules s ON s.season = g.season AND s.week = g.week
         AND g.team = CASE WHEN is_home = 1 THEN s.home_team ELSE s.away_team END""",
    "total_line team_spread")
add("p14_missing_line_flag", lambda d: C.team_games(d.star.schedules).select(
    "season", "week", "team", c("team_spread").isNull().cast("int").alias("missing_vegas_lines")),
    """SELECT season, week, team, CAST(team_spread IS NULL AS INTEGER) AS missing_vegas_lines
       FROM team_games""")
add("p15_clip_zero", lambda d: d.plays.select(
    "season", "week", "defteam", S.at_least_zero(c("yards_gained") - 25).alias("clipped")),
    """SELECT season, week, defteam, CASE WHEN yards_gained IS NOT NULL
         THEN greatest(yards_gained - 25, 0) END AS clipped FROM plays""", "clipped")
add("p16_rounding", lambda d: d.star.raw("lineitem").select(
    "l_orderkey", "l_linenumber", "l_quantity",
    S.round_even(c("l_quantity") / 4, 1).alias("even_1"),
    S.round_half_up(c("l_quantity") / 4, 1).alias("half_up_1"),
    S.round_even(c("l_quantity") / 8, 2).alias("even_2")),
    """SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 4, 1) AS even_1,
         round(l_quantity / 4, 1) AS half_up_1, round_even(l_quantity / 8, 2) AS even_2
       FROM lineitem""", "l_quantity even_1 half_up_1 even_2")
add("p17_numeric_only", lambda d: E.numeric_only(d.gold),
    "SELECT * EXCLUDE (player_id, player_name, recent_team, position, opponent, "
    "starting_qb_id, gameday) FROM gold", GOLD_DOUBLES)
_ALIGNED = ["prev_season_ppg", "temp", "absent_feature", "pos_QB", "week"]
add("p18_align_features", lambda d: E.one_hot(d.gold).select(
    "player_id", c("season").alias("at_season"), *E.align(E.one_hot(d.gold), _ALIGNED)),
    """SELECT player_id, season AS at_season, prev_season_ppg, temp, 0.0::DOUBLE AS absent_feature,
         CAST(coalesce(position = 'QB', false) AS DOUBLE) AS pos_QB, CAST(week AS DOUBLE) AS week FROM gold""",
    " ".join(_ALIGNED))
add("p19_one_hot", lambda d: E.one_hot(d.star.rosters).select(
    "player_id", "season", *[f"pos_{p}" for p in schema.POSITIONS]),
    "SELECT player_id, season, {} FROM rosters".format(", ".join(
        f"CAST(coalesce(position = '{p}', false) AS INTEGER) AS pos_{p}"
        for p in schema.POSITIONS)))


def _served(d: Domain):
    df = d.plays.select(
        "season", "week",
        F.when(c("air_yards") > 90, F.lit(float("nan"))).otherwise(c("air_yards")).alias("air"),
        c("yardline_100").cast("decimal(10,0)").alias("depth_chart_rank"),
        c("yardline_100").cast("decimal(10,2)").alias("yards"))
    return df.select(*S.serving_columns(df))


add("p20_serving_values", _served, """
    SELECT season, week, CASE WHEN air_yards <= 90 THEN air_yards END AS air,
      CAST(yardline_100 AS INTEGER) AS depth_chart_rank, yardline_100 AS yards FROM plays""",
    "air yards")
add("p21_optional_filters", lambda d: Q.matching(
    d.predictions, position=" rb ", min_projected=6.0, season=2001).select(
    "player_id", "week", "position", "projected_ppr"),
    """SELECT player_id, week, position, projected_ppr FROM predictions
       WHERE position = 'RB' AND projected_ppr >= 6 AND season = 2001""", "projected_ppr")
add("p22_numeric_coercion", lambda d: d.star.depth_weekly.select(
    "gsis_id", "season", "week", S.to_int("depth_team").alias("rank")),
    "SELECT gsis_id, season, week, TRY_CAST(depth_team AS INTEGER) AS rank FROM depth_weekly")
add("p23_parse_dates", lambda d: d.star.depth_snapshots.select(
    "gsis_id", S.day("dt").alias("day"),
    F.unix_seconds(S.instant("dt")).alias("epoch")),
    """SELECT gsis_id, CAST(dt_instant AS DATE) AS day,
         CAST(epoch(dt_instant) AS BIGINT) AS epoch FROM depth_snapshots""")

# --- scalar functions --------------------------------------------------------

add("f1_ppr_points", lambda d: B.box_score(d.box_plays).select(
    *B.GRAIN, "fantasy_points_ppr"),
    "SELECT season, week, player_id, player_name, fantasy_points_ppr FROM box",
    "fantasy_points_ppr")
add("f2_moneyline_probability", lambda d: d.star.schedules.select(
    "season", "week", "home_team",
    S.moneyline_probability("home_moneyline").alias("gold_prob"),
    S.moneyline_probability(c("home_moneyline") - 100, zero_is_underdog=False
                            ).alias("slate_prob")),
    """SELECT season, week, home_team,
         coalesce(CASE WHEN home_moneyline < 0 THEN -home_moneyline / (-home_moneyline + 100)
                       ELSE 100 / (home_moneyline + 100) END, 0.5::DOUBLE) AS gold_prob,
         CASE WHEN m IS NULL THEN 0.5::DOUBLE WHEN m > 0 THEN 100 / (m + 100)
              ELSE abs(m) / (abs(m) + 100) END AS slate_prob
       FROM (SELECT *, home_moneyline - 100 AS m FROM schedules)""", "gold_prob slate_prob")
add("f3_implied_totals", lambda d: d.star.schedules.select(
    "season", "week", "home_team",
    S.implied_total("total_line", "spread_line").alias("home_implied"),
    S.implied_total("total_line", -c("spread_line")).alias("away_implied")),
    """SELECT season, week, home_team, total_line / 2 + spread_line / 2 AS home_implied,
         total_line / 2 - spread_line / 2 AS away_implied FROM schedules""",
    "home_implied away_implied")
add("f4_safe_share", lambda d: d.plays.select(
    "season", "week", "posteam",
    S.ratio("air_yards", c("yardline_100") - 25).alias("share")),
    """SELECT season, week, posteam,
         coalesce(air_yards / nullif(yardline_100 - 25, 0), 0) AS share FROM plays""", "share")
add("f5_wopr", lambda d: d.gold.select(
    "player_id", "season", "week", S.wopr("target_share", "air_yards_share").alias("w")),
    """SELECT player_id, season, week, 1.5::DOUBLE * target_share
         + 0.7::DOUBLE * air_yards_share AS w FROM gold""", "w")
add("f6_adjusted_yards", lambda d: B.box_score(d.box_plays).select(
    *B.GRAIN, S.adjusted_yards_per_attempt(
        "passing_yards", "passing_tds", "interceptions", "pass_attempts").alias("aya")),
    """SELECT season, week, player_id, player_name, coalesce((passing_yards + 20 * passing_tds
         - 45 * interceptions) / nullif(pass_attempts, 0), 0) AS aya FROM box""", "aya")
add("f7_opportunities", lambda d: B.box_score(d.box_plays).select(
    *B.GRAIN, S.opportunities().alias("chances")),
    "SELECT season, week, player_id, player_name, rush_attempts + targets AS chances FROM box",
    "chances")
add("f8_errors_and_trend", lambda d: d.predictions.select(
    "player_id", "season", "week",
    S.absolute_error("actual_ppr", "projected_ppr").alias("abs_error"),
    S.delta("actual_ppr", "projected_ppr").alias("delta"),
    S.trend("projected_ppr", "fantasy_points_3wk_avg").alias("trend")),
    """SELECT player_id, season, week, abs(actual_ppr - projected_ppr) AS abs_error,
         actual_ppr - projected_ppr AS delta,
         CASE WHEN projected_ppr >= fantasy_points_3wk_avg THEN 'up'
              WHEN projected_ppr < fantasy_points_3wk_avg THEN 'down' END AS trend
       FROM predictions""", "abs_error delta")
add("f9_day_difference", lambda d: d.star.schedules.select(
    "season", "week", "home_team",
    S.days_between(F.to_date("gameday"), F.make_date("season", F.lit(1), F.lit(1))).alias("days")),
    """SELECT season, week, home_team, CAST(date_diff('day', make_date(season, 1, 1),
         CAST(gameday AS DATE)) AS INTEGER) AS days FROM schedules""")
add("f10_null_test_cast", lambda d: d.box_plays.groupBy("season", "week").agg(
    F.sum(c("yards_gained").isNull().cast("int")).alias("unknown_yards")),
    """SELECT season, week, CAST(sum(CAST(yards_gained IS NULL AS INTEGER)) AS BIGINT)
         AS unknown_yards FROM plays GROUP BY ALL""")
add("f11_name_search", lambda d: d.gold.where(L.name_contains(" PLAYER 1")).select(
    "player_id", "season", "week"),
    """SELECT player_id, season, week FROM gold
       WHERE contains(lower(player_name), 'player 1')""")
add("f12_labels", lambda d: d.predictions.select(
    "player_id", "season", "week", L.matchup().alias("matchup"), L.venue().alias("venue"),
    L.venue_note().alias("note"), *L.risk_flags()),
    """SELECT player_id, season, week,
         CASE WHEN coalesce(is_home, 0) <> 0 THEN 'vs' ELSE '@' END
           || coalesce(' ' || opponent, '') AS matchup,
         CASE WHEN is_dome = 1 THEN 'Dome' WHEN is_bad_weather = 1 THEN 'Bad weather'
              ELSE 'Outdoor' END AS venue,
         CASE WHEN is_dome = 1 THEN 'dome' WHEN is_bad_weather = 1 THEN 'weather' END AS note,
         CAST(coalesce(team_spread > 0, false) AS INTEGER) AS spread_risk,
         CAST(coalesce(team_win_prob < 0.4, false) AS INTEGER) AS win_prob_risk,
         CAST(coalesce(is_bad_weather = 1, false) AS INTEGER) AS weather_risk
       FROM predictions""")
add("f13_has_insight", lambda d: d.predictions.select(
    "player_id", "season", "week", L.has_text("insight").cast("int").alias("told")),
    """SELECT player_id, season, week,
         CAST(coalesce(length(trim(insight)) > 0, false) AS INTEGER) AS told FROM predictions""")

# --- text --------------------------------------------------------------------

_NUM = lambda x, default="0": f"coalesce(CAST({x} AS DOUBLE), {default})"
_STR = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')"
_HEAD = ("You are a fantasy football analyst. Using ONLY the data below, write a 2-3 sentence\n"
         "insight for this player''s upcoming game. Mention the projection, one supporting factor,\n"
         "and one risk factor. Do not invent injuries or news not present in the data.\n"
         "If recent form or opponent defense is listed as not available, do not treat it as "
         "zero skill.\n")
add("i1_prompt_text", lambda d: I.with_prompts(d.predictions).select(
    "player_id", "season", "week", "prompt"), f"""
    SELECT player_id, season, week, concat_ws(chr(10), '{_HEAD}',
      'Player: ' || {_STR('player_name')} || ' (' || {_STR('position')} || ', '
        || {_STR('recent_team')} || ')',
      'Opponent: ' || {_STR('opponent')} || ' ('
        || CASE WHEN {_NUM('is_home')} <> 0 THEN 'at home' ELSE 'on the road' END || ')',
      'Model projection: ' || {_STR('projected_ppr')} || ' PPR points',
      CASE WHEN {_NUM('fantasy_points_3wk_avg')} <> 0 THEN 'Recent form (3-week avg): '
        || CAST(fantasy_points_3wk_avg AS VARCHAR) || ' PPR points'
        ELSE 'Recent form (3-week avg): not available yet (no games played this season)' END,
      'Previous season average: ' || CAST({_NUM('prev_season_ppg')} AS VARCHAR) || ' PPR points',
      'Vegas implied team total: ' || CAST({_NUM('implied_total')} AS VARCHAR) || ' | spread: '
        || printf('%+.1f', {_NUM('team_spread')}) || ' | win prob: '
        || printf('%.0f', {_NUM('team_win_prob')} * 100) || '%',
      CASE WHEN {_NUM('opp_def_ppg_allowed')} <> 0 THEN 'Opponent defense allows '
        || CAST(opp_def_ppg_allowed AS VARCHAR) || ' PPR points/game to ' || {_STR('position')} || 's'
        ELSE 'Opponent ' || {_STR('position')}
          || ' defense allowed: not available yet (preseason / week 1)' END,
      'Depth chart rank: ' || CAST(CAST({_NUM('depth_chart_rank', '9')} AS INTEGER) AS VARCHAR),
      'Weather: ' || CASE WHEN {_NUM('is_dome')} <> 0 THEN 'indoors (dome)'
        ELSE printf('%.0f', {_NUM('temp')}) || 'F, ' || printf('%.0f', {_NUM('wind')})
          || ' mph wind'
          || CASE WHEN {_NUM('is_bad_weather')} <> 0 THEN ' — bad weather game' ELSE '' END END
    ) AS prompt FROM predictions""")
add("i2_template_insight", lambda d: I.with_templates(d.predictions).select(
    "player_id", "season", "week", "insight"),
    f"SELECT player_id, season, week, {TEMPLATE} AS insight FROM predictions")


def _refuses_some(request: str) -> str:
    """Stand-in for an external generator that fails for home games."""
    if "(at home)" in request:
        raise RuntimeError("refused")
    return request.split("\n")[6]


add("i3_generated_with_fallback", lambda d: I.with_generated(
    d.predictions, _refuses_some, "first_line").select(
    "player_id", "season", "week", "insight", "insight_source"), f"""
    SELECT player_id, season, week, CASE WHEN coalesce(is_home, 0) <> 0 THEN {TEMPLATE}
      ELSE 'Opponent: ' || {_STR('opponent')} || ' (on the road)' END AS insight,
      CASE WHEN coalesce(is_home, 0) <> 0 THEN 'offline_template' ELSE 'first_line' END
        AS insight_source
    FROM predictions""")


def _refuses_batches(requests: list[str]) -> list[str]:
    """Stand-in for a batch generator: one home game fails the whole batch."""
    return [_refuses_some(r) for r in requests]


add("i3_generated_in_batches", lambda d: I.with_generated_batches(
    d.predictions, _refuses_batches, "first_line", retries=0).select(
    "player_id", "season", "week", "insight", "insight_source"), f"""
    SELECT player_id, season, week, CASE WHEN coalesce(is_home, 0) <> 0 THEN {TEMPLATE}
      ELSE 'Opponent: ' || {_STR('opponent')} || ' (on the road)' END AS insight,
      CASE WHEN coalesce(is_home, 0) <> 0 THEN 'offline_template' ELSE 'first_line' END
        AS insight_source
    FROM predictions""")


def _insights_written(d: Domain):
    path = new_path(d.spark, "told")
    sinks.rebuild(I.without_insights(d.predictions), path)
    newest = Q.in_latest_slice(d.predictions)
    season, week = newest.select("season", "week").first()
    sinks.replace_slice(I.with_templates(newest), path, season, week)
    return tables.read_predictions(d.spark, path).select(
        "player_id", "season", "week", "projected_ppr", "insight", "insight_source")


def _before_newest(d: Domain):
    newest = Q.in_latest_slice(d.gold).select("season", "week").distinct()
    return d.gold.join(F.broadcast(newest), ["season", "week"], "left_anti")      # one row


def _weekly_run_all(d: Domain):
    """Gold ends a week before the history: the slate in it is kept, and every row told."""
    path = new_path(d.spark, "weekly")
    sinks.rebuild(I.without_insights(d.predictions), path)
    return weekly_run(_before_newest(d), path).select(
        "player_id", "season", "week", "projected_ppr", "insight", "insight_source")


add("i5_weekly_run_all", _weekly_run_all, f"""
    SELECT player_id, season, week, projected_ppr, {TEMPLATE} AS insight,
      'offline_template' AS insight_source FROM latest_slate""", "projected_ppr")


def _weekly_run_trained(d: Domain):
    """The history ends a week before gold: the newest week is projected, written, told."""
    def make():
        path = new_path(d.spark, "weekly")
        newest = Q.in_latest_slice(d.gold).select("season", "week").distinct()
        sinks.rebuild(I.without_insights(d.predictions.join(
            F.broadcast(newest), ["season", "week"], "left_anti")), path)            # one row
        return weekly_run(d.gold, path)
    return d.once("weekly", make).select(
        "player_id", "season", "week", "projected_ppr", "insight", "insight_source")


# learned projections: no SQL; what was written can be stated without them
add("i5_weekly_run_trained", _weekly_run_trained)
add("i5_trained_rows", lambda d: _weekly_run_trained(d).select(
    "player_id", "season", "week", "insight_source", c("insight").isNotNull().alias("told"),
    (c("projected_ppr") >= 0).alias("projected")), """
    SELECT player_id, g.season, g.week, 'offline_template' AS insight_source, TRUE AS told,
      TRUE AS projected
    FROM gold g JOIN last_slices s ON g.season = s.season AND g.week = s.week AND age = 1""")


add("i4_attach_insights", _insights_written, f"""
    SELECT player_id, season, week, projected_ppr,
      CASE WHEN actual_ppr IS NULL THEN {TEMPLATE} END AS insight,
      CASE WHEN actual_ppr IS NULL THEN 'offline_template' END AS insight_source
    FROM predictions""", "projected_ppr")
