"""Joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.suite import GOLD_DOUBLES, Domain, add
from checks.tables_sql import blend, shifted_ratio
from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A
from weekcast.operators import joins as J
from weekcast.operators import windows as W
from weekcast.plans import boxscore as B
from weekcast.plans import context as C
from weekcast.plans import evaluation as E
from weekcast.plans import features as FT
from weekcast.plans import serving as Q
from weekcast.plans import slate as SL
from weekcast.plans import views as V
from weekcast.session import stage
from weekcast.sources import catalog, sinks

c = F.col
BOX = " ".join(schema.BOX_COLUMNS)
GRAIN = ", ".join(B.GRAIN)


def players(d: Domain):
    """Identified box score with opponent context, as the joins see it."""
    facts = B.entity_week_facts(d.plays)
    return B.identified_box(facts, d.star.rosters)


def in_context(d: Domain):
    return J.lookup(players(d), C.game_context(d.star.schedules),
                    {"season": "season", "week": "week", "recent_team": "team"})


# --- flagship ----------------------------------------------------------------

add("gold_features", lambda d: FT.build_gold(d.sources),
    "SELECT * FROM gold", GOLD_DOUBLES)

# --- joins -------------------------------------------------------------------

add("j1_null_safe_outer", lambda d: B.box_score(d.box_plays),
    f"SELECT {GRAIN}, {BOX.replace(' ', ', ')}, fantasy_points_ppr FROM box",
    f"{BOX} fantasy_points_ppr")
_ROLES = ["season", "week", "play_type", "posteam", *[
    f"{r}_player_{x}" for r in ("passer", "rusher", "receiver") for x in ("id", "name")]]


def mentions(d: Domain):
    return B.player_mentions(d.star.plays(_ROLES))


def _position_lookup(d: Domain):
    known = B.player_positions(mentions(d), d.star.rosters).withColumnRenamed(
        "player_name", "known_name")
    box = B.box_score(d.box_plays)
    return J.lookup(box, known, {"player_id": "player_id"}).select(
        "season", "week", "player_id",
        F.coalesce("player_name", "known_name").alias("player_name"), "position")


add("j2_position_lookup", _position_lookup, """
    SELECT b.season, b.week, b.player_id, coalesce(b.player_name, p.player_name) AS player_name,
      p.position FROM box b LEFT JOIN player_position p ON b.player_id = p.player_id""")
add("j3_team_per_season", lambda d: B.box_score(d.box_plays).join(
    B.player_teams(mentions(d)), ["player_id", "season"], "left").select(
    "player_id", "season", "week", "recent_team"), """
    SELECT b.player_id, b.season, b.week, t.recent_team FROM box b
    LEFT JOIN player_team t ON b.player_id = t.player_id AND b.season = t.season""")
add("j4_game_context", lambda d: in_context(d).select(
    "player_id", "season", "week", "opponent", "gameday", *schema.CONTEXT_COLUMNS),
    "SELECT player_id, season, week, opponent, gameday, {} FROM players_in_context".format(
        ", ".join(schema.CONTEXT_COLUMNS)),
    "implied_total team_spread team_win_prob temp wind rest_advantage")
add("j5_opponent_rest", lambda d: C.game_context(d.star.schedules).select(
    "season", "week", "team", "rest_advantage"),
    "SELECT season, week, team, rest_advantage FROM games", "rest_advantage")


def _carry(d: Domain):
    ppg, games = W.previous_season_summary("fantasy_points_ppr", "player_id")
    return players(d).select("player_id", "season", "week", ppg.alias("prev_season_ppg"),
                             games.alias("prev_season_games"))


add("j6_season_shift", _carry, """
    SELECT i.player_id, i.season, i.week, coalesce(prev_season_ppg, 0) AS prev_season_ppg,
      coalesce(prev_season_games, 0) AS prev_season_games
    FROM identified i LEFT JOIN season_totals t
      ON t.player_id = i.player_id AND t.season = i.season""",
    "prev_season_ppg prev_season_games")


def _rates(d: Domain):
    facts = stage(B.entity_week_facts(d.plays), "facts")
    own = FT.sack_rates(B.offense_weeks(facts), "team_sack_rate_allowed")
    faced = FT.sack_rates(B.defense_weeks(facts), "opp_def_sack_rate")
    games = C.team_games(d.star.schedules).select("season", "week", "team", "opponent")
    keys = {"season": "season", "week": "week"}
    return J.lookup(J.lookup(games, own, {**keys, "team": "team"}), faced,
                    {**keys, "opponent": "team"})


add("j7_entity_rates", _rates, """
    SELECT g.season, g.week, g.team, g.opponent, team_sack_rate_allowed, opp_def_sack_rate
    FROM games g
    LEFT JOIN offense_sacks o ON o.posteam = g.team AND o.season = g.season AND o.week = g.week
    LEFT JOIN defense_sacks s ON s.defteam = g.opponent AND s.season = g.season
      AND s.week = g.week""", "team_sack_rate_allowed opp_def_sack_rate")


def _totals(d: Domain):
    facts = stage(B.entity_week_facts(d.plays), "facts")
    who = B.identified_box(facts, d.star.rosters)
    return J.lookup(who.select("player_id", "season", "week", "recent_team"),
                    B.offense_weeks(facts).drop("any_dropback", "dropbacks", "sacks"),
                    {"season": "season", "week": "week", "recent_team": "team"})


add("j8_team_totals", _totals, """
    SELECT i.player_id, i.season, i.week, i.recent_team, team_total_opportunities,
      team_pass_attempts, team_air_yards
    FROM identified i LEFT JOIN team_totals t
      ON t.team = i.recent_team AND t.season = i.season AND t.week = i.week""",
    "team_total_opportunities team_pass_attempts team_air_yards")
add("j9_player_side_metrics", lambda d: players(d).join(
    FT.snap_shares(d.star.snap_counts, d.star.rosters), FT.PLAYER_WEEK, "left").select(
    *FT.PLAYER_WEEK, "hvt_carries", "hvt_targets", "player_air_yards", "snap_share"),
    """SELECT player_id, season, week, hvt_carries, hvt_targets, player_air_yards,
         s.snap_share FROM shares JOIN (SELECT player_id, season, week FROM shares)
         USING (player_id, season, week)
         LEFT JOIN snaps s USING (player_id, season, week)""",
    "hvt_carries hvt_targets player_air_yards snap_share")
add("j10_id_mapping", lambda d: FT.snap_shares(d.star.snap_counts, d.star.rosters),
    "SELECT player_id, season, week, snap_share FROM snaps", "snap_share")


def _starter_rate(d: Domain):
    games = C.game_context(d.star.schedules).select("season", "week", "team", "starting_qb_id")
    return J.lookup(games, FT.quarterback_efficiency(players(d)), {
        "starting_qb_id": "player_id", "season": "season", "week": "week"})


add("j11_starting_qb_rate", _starter_rate, """
    SELECT g.season, g.week, g.team, g.starting_qb_id, q.starting_qb_aya FROM games g
    LEFT JOIN qb_aya q ON q.player_id = g.starting_qb_id AND q.season = g.season
      AND q.week = g.week""", "starting_qb_aya")


def _allowed(d: Domain):
    rows = in_context(d)
    return J.lookup(
        rows.select("player_id", "season", "week", "opponent", "position"),
        FT.points_allowed(rows), {"opponent": "team", "season": "season", "week": "week",
                                  "position": "position"})


add("j12_four_key_lookup", _allowed, """
    SELECT p.player_id, p.season, p.week, p.opponent, p.position, d.opp_def_ppg_allowed
    FROM players_in_context p LEFT JOIN defense_points d ON d.opponent = p.opponent
      AND d.season = p.season AND d.week = p.week AND d.position = p.position""",
    "opp_def_ppg_allowed")


def _grid(d: Domain):
    who = players(d)
    return FT.receiver_grid(who, FT.games_calendar(who)).drop("team")


add("j13_densified_grid", _grid, "SELECT player_id, season, week, targets FROM wr_grid",
    "targets")
add("j14_out_flag", lambda d: d.star.rosters.select("player_id", "season").distinct().join(
    FT.out_players(d.star.injuries), ["player_id", "season"], "left").groupBy(
    "player_id", "season").agg(F.count("week").alias("weeks_out")), """
    SELECT r.player_id, r.season, count(o.week) AS weeks_out
    FROM (SELECT DISTINCT player_id, season FROM rosters) r
    LEFT JOIN out_reports o ON o.player_id = r.player_id AND o.season = r.season
    GROUP BY ALL""")
add("j15_asof_depth", lambda d: J.asof_backward(
    in_context(d).select("player_id", "season", "week", "gameday"),
    FT.snapshot_ranks(d.star.depth_snapshots), "player_id", "gameday", "snapshot_day",
    "rank_snapshot"), """
    SELECT p.player_id, p.season, p.week, p.gameday, s.rank_snapshot
    FROM players_in_context p ASOF LEFT JOIN snapshot_rank s
      ON s.player_id = p.player_id AND s.snapshot_day <= p.gameday""")


def _asof_orders(d: Domain, bucket=None):
    orders, lines = d.star.raw("orders"), d.star.raw("lineitem")
    shipped = lines.join(orders.select("o_orderkey", "o_custkey"),
                         c("l_orderkey") == c("o_orderkey")).select(
        "o_custkey", "l_shipdate", "l_linenumber")
    return J.asof_backward(orders.select("o_orderkey", "o_custkey", "o_orderdate"), shipped,
                           "o_custkey", "o_orderdate", "l_shipdate", "l_linenumber",
                           out="last_line", bucket=bucket).drop("o_orderdate")


_ASOF = """
    SELECT o.o_orderkey, o.o_custkey, s.last_line FROM orders o
    ASOF LEFT JOIN (SELECT o_custkey, l_shipdate, min(l_linenumber) AS last_line
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) s
      ON s.o_custkey = o.o_custkey AND s.l_shipdate <= o.o_orderdate"""
add("j15_asof_orders", _asof_orders, _ASOF)
add("j15_asof_orders_bucketed", lambda d: _asof_orders(d, "year"), _ASOF)


def _asof_events_hot(d: Domain):
    """Last purchase value at or before every event; a third of all users share a key."""
    events = d.star.raw("events").withColumn(
        "who", F.when(c("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(c("user_id")))
    bought = events.where(c("event_type") == "purchase").select(
        "who", c("ts").alias("at"), c("value").alias("paid"))
    return J.asof_segmented(events.select("event_id", "who", "ts"), bought, "who", "ts",
                            "at", "paid").select("event_id", "who", "paid")


add("j15_asof_segmented", _asof_events_hot, """
    WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS who FROM events)
    SELECT e.event_id, e.who, p.value AS paid FROM e
    ASOF LEFT JOIN (SELECT who, ts, min(value) AS value FROM e
      WHERE event_type = 'purchase' GROUP BY ALL) p
      ON p.who = e.who AND p.ts <= e.ts""", "paid")


def _asof_events(d: Domain):
    """Last purchase value at or before every event, bucketed by hour."""
    events = d.star.raw("events")
    bought = events.where(c("event_type") == "purchase").select(
        "user_id", c("ts").alias("at"), c("value").alias("paid"))
    return J.asof_backward(events.select("event_id", "user_id", "ts"), bought, "user_id", "ts",
                           "at", "paid", bucket="hour").select("event_id", "user_id", "paid")


add("j15_asof_events", _asof_events, """
    SELECT e.event_id, e.user_id, p.value AS paid FROM events e
    ASOF LEFT JOIN (SELECT user_id, ts, min(value) AS value FROM events
      WHERE event_type = 'purchase' GROUP BY ALL) p
      ON p.user_id = e.user_id AND p.ts <= e.ts""", "paid")


def _slate_roster(d: Domain, week=2):
    as_of = SL.first_gameday(d.star.schedules, 2001, week)
    return SL.eligible_roster(d.star.rosters, d.star.depth_snapshots, 2001, as_of).join(
        C.slate_context(d.star.schedules, 2001, week), "team")


def latest_rank_sql(week: int | None = None) -> str:
    """Ranks of the newest 2001 snapshots, up to the first game of a week."""
    known = "" if week is None else f"""AND CAST(dt_instant AS DATE) <= (
        SELECT min(gameday) FROM games WHERE season = 2001 AND week = {week})"""
    return f"""(SELECT gsis_id, arg_max(r, dt_instant) AS pos_rank FROM (
      SELECT gsis_id, dt_instant, min(pos_rank) AS r FROM depth_snapshots
      WHERE pos_abb IN ('QB', 'RB', 'WR', 'TE', 'FB') AND year(dt_instant) = 2001 {known}
      GROUP BY ALL) GROUP BY gsis_id)"""


def slate_roster_sql(week: int | None = None) -> str:
    return f"""(SELECT r.player_id, r.full_name AS player_name, r.position, r.team,
      CAST(coalesce(k.pos_rank, 99) AS INTEGER) AS depth_chart_rank
    FROM rosters r LEFT JOIN {latest_rank_sql(week)} k ON k.gsis_id = r.player_id
    WHERE r.season = 2001 AND r.position IN ('QB', 'RB', 'WR', 'TE')
      AND (r.position NOT IN ('QB', 'TE') OR coalesce(k.pos_rank, 99) = 1))"""


SLATE_ROSTER = slate_roster_sql(2)
add("j16_slate_inner", lambda d: _slate_roster(d).select(
    "player_id", "team", "opponent", "is_home", "depth_chart_rank"), f"""
    SELECT e.player_id, e.team, g.opponent, g.is_home, e.depth_chart_rank
    FROM {SLATE_ROSTER} e JOIN games g ON g.team = e.team AND g.season = 2001 AND g.week = 2""")
add("j17_latest_rank", lambda d: d.star.rosters.join(
    SL.latest_depth_ranks(d.star.depth_snapshots, 2001), "player_id", "left").select(
    "player_id", "season",
    F.coalesce("pos_rank", F.lit(schema.SLATE_UNLISTED_RANK)).alias("rank")), f"""
    SELECT r.player_id, r.season, CAST(coalesce(k.pos_rank, 99) AS INTEGER) AS rank
    FROM rosters r LEFT JOIN {latest_rank_sql()} k ON k.gsis_id = r.player_id""")
add("j18_roster_predictions", lambda d: Q.team_roster(d.gold, d.predictions, "T3").select(
    "player_id", "projected_ppr"), """
    SELECT r.player_id, p.projected_ppr
    FROM (SELECT DISTINCT player_id FROM gold WHERE recent_team = 'T3') r
    LEFT JOIN latest_slate p ON p.player_id = r.player_id""", "projected_ppr")
add("j19_row_key_join", lambda d: J.same_rows(
    E.naive_form(d.gold),
    E.naive_previous_season(d.gold).select(*E.ROW_KEY, c("predicted").alias("other")),
    E.ROW_KEY).select(*E.ROW_KEY, "actual", "predicted", "other"), """
    SELECT player_id, player_name, season, week, fantasy_points_ppr AS actual,
      fantasy_points_3wk_avg AS predicted, greatest(prev_season_ppg, 0) AS other FROM gold""",
    "actual predicted other")
_PASSERS = """(SELECT player_id AS qb, recent_team AS team, pass_attempts,
      coalesce((passing_yards + 20 * passing_tds - 45 * interceptions)
        / nullif(pass_attempts, 0), 0) AS aya
    FROM gold WHERE season = 2001 AND week = 1 AND position = 'QB')"""
_TEAM_PASSERS = f"""(SELECT * FROM {_PASSERS} WHERE team IS NOT NULL QUALIFY row_number() OVER (
      PARTITION BY team ORDER BY pass_attempts DESC, qb) = 1)"""


def _with_passers(d: Domain):
    slate = _slate_roster(d).withColumnRenamed("team", "recent_team")
    return SL.with_passers(slate, SL.passer_efficiency(d.gold, 2001, 2)).select(
        "player_id", "recent_team", "position", "starting_qb_id", "starting_qb_aya")


PASSED = f"""
    SELECT e.player_id, e.team AS recent_team, e.position,
      CASE WHEN e.position = 'QB' THEN e.player_id ELSE t.qb END AS starting_qb_id,
      coalesce(CASE WHEN e.position = 'QB' THEN o.aya ELSE t.aya END, 0) AS starting_qb_aya
    FROM {SLATE_ROSTER} e JOIN games g ON g.team = e.team AND g.season = 2001 AND g.week = 2
    LEFT JOIN {_TEAM_PASSERS} t ON t.team = e.team
    LEFT JOIN {_PASSERS} o ON o.qb = e.player_id"""
add("j20_id_map_lookup", _with_passers, PASSED, "starting_qb_aya")


def _merge_text(d: Domain):
    told = d.predictions.where(c("actual_ppr").isNull()).select("player_id", "insight")
    base = d.predictions.where(c("actual_ppr").isNull()).drop("insight")
    return base.join(told, "player_id", "left").select("player_id", "projected_ppr", "insight")


add("j21_merge_text", _merge_text,
    "SELECT player_id, projected_ppr, insight FROM predictions WHERE actual_ppr IS NULL",
    "projected_ppr")
add("j22_team_passers", lambda d: SL.team_passers(
    SL.passer_efficiency(d.gold, 2001, 2)).select("team", "starting_qb_id", "starting_qb_aya"),
    f"SELECT team, qb AS starting_qb_id, aya AS starting_qb_aya FROM {_TEAM_PASSERS}",
    "starting_qb_aya")

# --- aggregations ------------------------------------------------------------

add("a1_passer_box", lambda d: B.passer_box(d.box_plays), "SELECT * FROM pass_box",
    "pass_attempts completions passing_yards passing_tds interceptions")
add("a2_rusher_box", lambda d: B.rusher_box(d.box_plays), "SELECT * FROM rush_box",
    "rush_attempts rushing_yards rushing_tds")
add("a3_receiver_box", lambda d: B.receiver_box(d.box_plays), "SELECT * FROM recv_box",
    "targets receptions receiving_yards receiving_tds")
add("a4_single_season_box", lambda d: B.box_score(d.box_plays.where(c("season") == 2000)).drop(
    "season"), "SELECT week, player_id, player_name, {}, fantasy_points_ppr FROM box "
    "WHERE season = 2000".format(BOX.replace(" ", ", ")), f"{BOX} fantasy_points_ppr")
add("a5_modal_position", lambda d: A.mode_by_count(mentions(d), "player_id", "position"),
    "SELECT * FROM modal_position")
add("a5_modal_event", lambda d: A.mode_by_count(
    d.star.raw("events"), "user_id", "event_type"), """
    SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events
      GROUP BY ALL) QUALIFY row_number() OVER (
      PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
add("a6_first_name", lambda d: A.first_by(
    mentions(d), "player_id", "player_name", ["role_order", "season", "week"]),
    "SELECT * FROM first_name")
add("a7_latest_team", lambda d: B.player_teams(mentions(d)), "SELECT * FROM player_team")
add("a8_season_mean", lambda d: players(d).groupBy("player_id", "season").agg(
    F.avg("fantasy_points_ppr").alias("ppg"), F.count(F.lit(1)).alias("games")), """
    SELECT player_id, season, avg(fantasy_points_ppr) AS ppg, count(*) AS games
    FROM identified GROUP BY ALL""", "ppg")
add("a9_carryover", lambda d: SL.carryover(d.gold, 2001, schema.FANTASY_MAX_WEEK), """
    SELECT player_id, avg(fantasy_points_ppr) AS prev_season_ppg,
      CAST(count(fantasy_points_ppr) AS DOUBLE) AS prev_season_games
    FROM gold WHERE season = 2000 AND week <= 17 GROUP BY ALL""",
    "prev_season_ppg prev_season_games")
add("a10_team_week_sums", lambda d: B.offense_weeks(B.entity_week_facts(d.plays)).drop(
    "any_dropback"), """
    SELECT posteam AS team, season, week, sum(qb_dropback) FILTER (qb_dropback = 1) AS dropbacks,
      sum(sack) FILTER (qb_dropback = 1) AS sacks,
      sum(rush_attempt) + sum(pass_attempt) AS team_total_opportunities,
      sum(pass_attempt) AS team_pass_attempts, sum(air_yards) AS team_air_yards
    FROM plays GROUP BY ALL""",
    "dropbacks sacks team_total_opportunities team_pass_attempts team_air_yards")
add("a11_red_zone_counts", lambda d: players(d).where(
    (c("hvt_carries") > 0) | (c("hvt_targets") > 0)).select(
    *FT.PLAYER_WEEK, "hvt_carries", "hvt_targets"), """
    SELECT player_id, season, week, CAST(coalesce(hvt_carries, 0) AS DOUBLE) AS hvt_carries,
      CAST(coalesce(hvt_targets, 0) AS DOUBLE) AS hvt_targets
    FROM hvt_runs FULL JOIN hvt_passes USING (player_id, season, week)""",
    "hvt_carries hvt_targets")
add("a12_max_snap_share", lambda d: d.star.snap_counts.groupBy("pfr_player_id", "season").agg(
    F.max("offense_pct").alias("best")), """
    SELECT pfr_player_id, season, max(offense_pct) AS best FROM snap_counts GROUP BY ALL""",
    "best")
add("a13_min_rank", lambda d: FT.snapshot_ranks(d.star.depth_snapshots),
    "SELECT * FROM snapshot_rank")
add("a14_distinct", lambda d: FT.out_players(d.star.injuries), "SELECT * FROM out_reports")
add("a15_keep_last", lambda d: A.keep_one(
    d.star.rosters.where(c("position").isNotNull()), ["player_id"],
    [F.desc("season"), F.desc("position")]).select("player_id", "season", "position"), """
    SELECT player_id, season, position FROM rosters WHERE position IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, position DESC) = 1""")
add("a16_points_allowed", lambda d: in_context(d).where(
    c("opponent").isNotNull() & c("position").isNotNull()).groupBy(
    "opponent", "season", "week", "position").agg(
    F.sum("fantasy_points_ppr").alias("points")), """
    SELECT opponent, season, week, position, sum(fantasy_points_ppr) AS points
    FROM players_in_context WHERE opponent IS NOT NULL AND position IS NOT NULL GROUP BY ALL""",
    "points")
add("a17_defense_plays", lambda d: B.defense_weeks(B.entity_week_facts(d.plays)).where(
    "play_count > 0").select("team", "season", "week", "play_yards", "play_count"), """
    SELECT defteam AS team, season, week, sum(yards_gained) AS play_yards,
      CAST(count(*) AS DOUBLE) AS play_count
    FROM plays WHERE play_type IN ('run', 'pass') GROUP BY ALL""", "play_yards play_count")


def _health(d: Domain):
    who = stage(players(d), "players")
    leaders = FT.leading_receivers(FT.receiver_grid(who, FT.games_calendar(who)))
    return FT.receiver_health(leaders, FT.out_players(d.star.injuries))


add("a18_all_healthy", _health,
    "SELECT recent_team AS team, season, week, wr1_wr2_healthy FROM wr_health")
_ERROR = "avg(abs(fantasy_points_ppr - fantasy_points_3wk_avg))"
add("a19_overall_mae", lambda d: A.mean_absolute_error(
    E.naive_form(d.gold), "actual", "predicted"),
    f"SELECT {_ERROR} AS mae, count(*) AS n FROM gold", "mae")
add("a20_mae_by_position", lambda d: E.mae_by_position(
    E.naive_form(d.gold.where(c("position") != "TE"))), f"""
    SELECT p.position, round_even(mae, 2) AS mae, n
    FROM (VALUES ('QB'), ('RB'), ('WR'), ('TE')) p(position)
    LEFT JOIN (SELECT position, {_ERROR} AS mae, count(*) AS n FROM gold
      WHERE position <> 'TE' GROUP BY ALL) g ON g.position = p.position""", "mae")
add("a21_mae_by_week", lambda d: E.mae_by_week({
    "form": E.naive_form(d.gold), "last_season": E.naive_previous_season(d.gold)}), f"""
    SELECT week AS test_week, {_ERROR} AS form,
      avg(abs(fantasy_points_ppr - greatest(prev_season_ppg, 0))) AS last_season
    FROM gold GROUP BY ALL""", "form last_season")
add("a22_training_mean", lambda d: E.naive_training_mean(
    d.gold.where("season = 2001"), d.gold.where("season < 2001")).select(
    *E.ROW_KEY, "predicted"), """
    SELECT player_id, player_name, season, week,
      (SELECT avg(fantasy_points_ppr) FROM gold WHERE season < 2001) AS predicted
    FROM gold WHERE season = 2001""", "predicted")
add("a23_profile", lambda d: A.profile(d.gold, "player_id"), """
    SELECT count(*) AS total_rows, (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season)
      FROM (SELECT DISTINCT season FROM gold)) AS seasons,
      min(week) AS min_week, max(week) AS max_week, count(DISTINCT player_id) AS players
    FROM gold""")
add("a24_value_counts", lambda d: A.value_counts(d.gold, "position", "depth_chart_rank"), """
    SELECT position, depth_chart_rank, count(*) AS n FROM gold GROUP BY ALL""")
add("a25_null_counts", lambda d: A.null_counts(d.plays), """
    SELECT column_name, nulls FROM (
      SELECT * FROM (SELECT {} FROM plays) UNPIVOT (nulls FOR column_name IN ({})))
    WHERE nulls > 0""".format(
        ", ".join(f"count(*) - count({f.name}) AS {f.name}" for f in schema.PLAYS.fields),
        ", ".join(f.name for f in schema.PLAYS.fields)))
CAREER = """SELECT player_id, CAST(count(*) AS INTEGER) AS games_played,
      min(season) AS first_season, max(season) AS last_season,
      avg(fantasy_points_ppr) AS career_ppg, max(fantasy_points_ppr) AS career_high
    FROM gold GROUP BY player_id"""
add("a26_career", lambda d: Q.career(d.gold), CAREER, "career_ppg career_high")
add("a27_slice_counts", lambda d: sinks.slice_counts(d.gold),
    "SELECT season, week, count(*) AS row_count FROM gold GROUP BY ALL")
add("a28_latest_slice", lambda d: A.latest_slice(d.plays),
    "SELECT season, week FROM plays ORDER BY season DESC, week DESC LIMIT 1")



def _latest_from_catalog(d: Domain):
    """The newest slice of gold, read from the catalog's list of partitions."""
    return catalog.slices(d.spark, d.table_name("gold")).agg(
        F.max(F.struct("season", "week")).alias("latest")).select("latest.season", "latest.week")


add("a28_latest_from_catalog", _latest_from_catalog,
    "SELECT season, week FROM gold ORDER BY season DESC, week DESC LIMIT 1")
add("a29_last_game_date", lambda d: C.last_game_dates(
    d.star.schedules.where("season = 2001"), 1), """
    SELECT team, max(gameday) AS gameday FROM team_games WHERE season = 2001 AND week = 1
    GROUP BY ALL""")
add("a30_allowed_per_row", lambda d: SL.points_allowed_per_row(d.gold, 2001, 2), """
    SELECT opponent, position, avg(fantasy_points_ppr) AS opp_def_ppg_allowed FROM gold
    WHERE season = 2001 AND week < 2 AND opponent IS NOT NULL AND position IS NOT NULL
    GROUP BY ALL""", "opp_def_ppg_allowed")
_LAST4 = """(SELECT player_id, week, wopr FROM gold WHERE season = 2000 QUALIFY row_number()
      OVER (PARTITION BY player_id ORDER BY week DESC) <= 4)"""
add("a31_last_games_sum", lambda d: SL.last_games(d.gold, 2000, 4, "wopr"), f"""
    SELECT player_id, sum(wopr) AS recent_sum, count(wopr) AS recent_games FROM {_LAST4}
    GROUP BY ALL""", "recent_sum")


add("a33_games_in_slate", lambda d: V.slate_teams(d.predictions).agg(
    F.floor(F.count(F.lit(1)) / 2 + 0.5).cast("int").alias("games")), """
    SELECT CAST(floor(count(*) / 2 + 0.5) AS INTEGER) AS games FROM (
      SELECT recent_team AS t FROM latest_slate WHERE recent_team IS NOT NULL
      UNION SELECT opponent FROM latest_slate WHERE opponent IS NOT NULL)""")
add("a34_slate_report", lambda d: d.gold.groupBy("season").agg(
    F.count(F.lit(1)).alias("players"),
    F.count_if(c("position") == "WR").alias("receivers"),
    F.count_if(c("fantasy_points_3wk_avg") != 0).alias("with_form")), """
    SELECT season, count(*) AS players, count(*) FILTER (position = 'WR') AS receivers,
      count(*) FILTER (fantasy_points_3wk_avg <> 0) AS with_form FROM gold GROUP BY ALL""")

# --- windows -----------------------------------------------------------------


def _blend_players(d: Domain, n: int):
    rows = players(d).select("player_id", "season", "week", "fantasy_points_ppr")
    return W.blended_means(rows, ["fantasy_points_ppr"], [n], entity="player_id",
                           name=lambda m, k: "blend").select(
        "player_id", "season", "week", "blend")


def _blend_sql(n: int, source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, season, week, {blend(value, n)} AS blend FROM (
      SELECT *, list_filter(h, lambda x: x.s = season) AS cur,
        list_filter(h, lambda x: x.s = season - 1) AS prev
      FROM (SELECT *, coalesce(list({{'s': season, '{value}': {value}}}) OVER (
        PARTITION BY {key} ORDER BY season, week ROWS BETWEEN {3 * n} PRECEDING
        AND 1 PRECEDING), []) AS h FROM {source}))"""


for _n in schema.WINDOWS:
    add(f"w1_blend_{_n}", lambda d, n=_n: _blend_players(d, n),
        _blend_sql(_n, "identified", "player_id", "fantasy_points_ppr"), "blend")


def _blend_customers(d: Domain):
    spent = d.star.raw("orders").groupBy(
        "o_custkey", F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("week")).agg(F.sum("o_totalprice").alias("spent"))
    return W.blended_means(spent, ["spent"], [5], entity="o_custkey",
                           name=lambda m, k: "blend").select(
        "o_custkey", "season", "week", F.round("blend", 7).alias("blend"))


add("w1_blend_sparse", _blend_customers, "SELECT * REPLACE (round(blend, 7) AS blend) FROM ({})".format(
    _blend_sql(5, """(SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season,
        CAST(month(o_orderdate) AS INTEGER) AS week, sum(o_totalprice) AS spent
      FROM orders GROUP BY ALL)""", "o_custkey", "spent")), "blend")
add("w2_games_count", lambda d: players(d).select(
    "player_id", "season", "week", W.games_before("player_id", 5).alias("games")), """
    SELECT player_id, season, week, CAST(len(cur) AS INTEGER) AS games FROM histories""")
add("w3_days_since_last", lambda d: C.with_rest(C.team_games(d.star.schedules).withColumn(
    "gameday", F.to_date("gameday"))).select("season", "week", "team", "days_since_last_game"),
    """SELECT season, week, team, CAST(days_since_last_game AS INTEGER) AS days_since_last_game
       FROM rested_games""")
add("w4_season_to_date_rate", lambda d: FT.yard_rates(
    B.defense_weeks(B.entity_week_facts(d.plays)), "run_yards", "run_plays", "rate"),
    """SELECT defteam AS team, season, week, opp_def_ypc_allowed AS rate FROM rush_defense""",
    "rate")
add("w5_weeks_seen_mean", lambda d: FT.points_allowed(in_context(d)), """
    SELECT opponent AS team, season, week, position, opp_def_ppg_allowed FROM defense_points""",
    "opp_def_ppg_allowed")
add("w6_prior_cumulative", lambda d: _grid(d).select(
    *FT.PLAYER_WEEK, W.prior_total("targets", ["player_id"]).alias("prior_targets")), """
    SELECT player_id, season, week, sum(targets) OVER (
      PARTITION BY player_id, season ORDER BY week) - targets AS prior_targets FROM wr_grid""",
    "prior_targets")


def _leaders(d: Domain):
    who = stage(players(d), "players")
    return FT.leading_receivers(FT.receiver_grid(who, FT.games_calendar(who)))


add("w7_top_two_receivers", _leaders, """
    SELECT player_id, season, week, prior_targets, recent_team AS team,
      CAST(wr_rank AS INTEGER) AS wr_rank FROM wr_ranked WHERE wr_rank <= 2""",
    "prior_targets")
add("w8_carry_forward", lambda d: d.unfiltered_gold.select(
    *FT.PLAYER_WEEK, "depth_chart_rank"),
    "SELECT player_id, season, week, depth_chart_rank FROM gold_all")


def _carry_weekly(d: Domain):
    listed = d.star.snap_counts.select(
        F.concat(F.lit("P"), F.substring("pfr_player_id", 2, 20)).alias("player_id"),
        "season", "week")
    ranks = listed.join(FT.weekly_ranks(d.star.depth_weekly), FT.PLAYER_WEEK, "left")
    return ranks.select(*FT.PLAYER_WEEK, W.carry_forward(
        "rank_weekly", ["player_id", "season"], default=9).alias("rank"))


add("w8_carry_forward_weekly", _carry_weekly, """
    SELECT s.player_id, s.season, s.week, coalesce(last_value(rank_weekly IGNORE NULLS) OVER (
      PARTITION BY s.player_id, s.season ORDER BY s.week
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS rank
    FROM (SELECT 'P' || substr(pfr_player_id, 2) AS player_id, season, week FROM snap_counts) s
    LEFT JOIN weekly_rank w ON w.player_id = s.player_id AND w.season = s.season
      AND w.week = s.week""")
add("w9_own_name_fill", lambda d: A.first_by(
    B.passer_box(d.box_plays).withColumn("zero", F.lit(0)), "player_id", "player_name",
    ["season", "week"]), """
    SELECT player_id, arg_min(player_name, season * 100 + week) AS player_name FROM pass_box
    WHERE player_id IS NOT NULL AND player_name IS NOT NULL GROUP BY ALL""")
_LATEST = ("QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, "
           "week DESC, player_name) = 1")
add("w10_latest_appearance", lambda d: Q.latest_appearances(d.gold, [
    "player_id", "player_name", "position", "recent_team", "season", "week", "opponent"]), f"""
    SELECT player_id, player_name, position, recent_team, season, week, opponent FROM gold
    {_LATEST}""")
add("w11_latest_on_team", lambda d: Q.latest_on_team(d.gold, "t3"), f"""
    SELECT player_id, player_name, position, recent_team, opponent, season, week,
      fantasy_points_ppr, depth_chart_rank FROM gold WHERE recent_team = 'T3' {_LATEST}""",
    "fantasy_points_ppr")
add("w12_total_with_page", lambda d: Q.page(
    d.gold.select("player_id", "season", "week"),
    [F.desc("season"), F.desc("week"), F.asc("player_id")], 20, 40), """
    SELECT player_id, season, week, CAST((SELECT count(*) FROM gold) AS INTEGER) AS total
    FROM gold ORDER BY season DESC, week DESC, player_id NULLS FIRST LIMIT 20 OFFSET 40""")
add("w13_last_rows", lambda d: A.top_per_group(
    d.gold.where("season = 2000").select("player_id", "week", "wopr"), ["player_id"],
    [F.desc("week")], 4), f"""
    SELECT player_id, week, wopr, CAST(row_number() OVER (
      PARTITION BY player_id ORDER BY week DESC) AS INTEGER) AS rank FROM {_LAST4}""", "wopr")
add("w14_slate_rank", lambda d: A.ranked(
    d.gold.select("player_id", "season", "week", "fantasy_points_ppr"), ["season", "week"],
    [F.desc("fantasy_points_ppr"), F.asc("player_id")]), """
    SELECT player_id, season, week, fantasy_points_ppr, CAST(row_number() OVER (
      PARTITION BY season, week ORDER BY fantasy_points_ppr DESC, player_id) AS INTEGER) AS rank
    FROM gold""", "fantasy_points_ppr")

# --- sorts and top-k ----------------------------------------------------------

add("l1_order_by_score", lambda d: B.box_score(d.box_plays).orderBy(
    F.desc("fantasy_points_ppr"), *B.GRAIN).select(*B.GRAIN, "fantasy_points_ppr"),
    f"SELECT {GRAIN}, fantasy_points_ppr FROM box", "fantasy_points_ppr")
add("l2_top_rows", lambda d: d.gold.orderBy(
    F.desc("fantasy_points_ppr"), "player_id", "season", "week").limit(5).select(
    *FT.PLAYER_WEEK, "fantasy_points_ppr"), """
    SELECT player_id, season, week, fantasy_points_ppr FROM gold
    ORDER BY fantasy_points_ppr DESC, player_id, season, week LIMIT 5""", "fantasy_points_ppr")
add("l3_top_per_position", lambda d: A.top_per_group(
    d.predictions.where(c("actual_ppr").isNull()).select(
        "player_id", "position", "projected_ppr"), ["position"],
    [F.desc_nulls_last("projected_ppr"), F.asc("player_id")], 5), """
    SELECT player_id, position, projected_ppr, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY position
        ORDER BY projected_ppr DESC NULLS LAST, player_id) AS r
      FROM predictions WHERE actual_ppr IS NULL) WHERE r <= 5""", "projected_ppr")
add("l4_limit_offset", lambda d: d.gold.select(*FT.PLAYER_WEEK).orderBy(
    *FT.PLAYER_WEEK).offset(100).limit(50), """
    SELECT player_id, season, week FROM gold ORDER BY player_id NULLS FIRST, season, week
    LIMIT 50 OFFSET 100""")
add("l5_nulls_last", lambda d: d.predictions.orderBy(
    F.desc_nulls_last("projected_ppr"), "player_name", "season", "week").select(
    "player_id", "season", "week", "projected_ppr"), """
    SELECT player_id, season, week, projected_ppr FROM predictions
    ORDER BY projected_ppr DESC NULLS LAST, player_name NULLS FIRST, season, week""",
    "projected_ppr")
add("l6_chosen_key", lambda d: V.rankings(
    d.predictions, key="team_spread", descending=False).select(
    "player_id", "team_spread", "total"), """
    SELECT player_id, team_spread, CAST((SELECT count(*) FROM latest_slate) AS INTEGER) AS total
    FROM latest_slate ORDER BY team_spread ASC NULLS LAST, player_id LIMIT 50""",
    "team_spread")
add("l7_depth_order", lambda d: A.ranked(
    d.gold.select("player_id", "season", "week", "recent_team", "position", "depth_chart_rank"),
    ["season", "recent_team"], [V.position_order(), F.coalesce(
        "depth_chart_rank", F.lit(99)), F.asc("player_id"), F.asc("week")]), """
    SELECT player_id, season, week, recent_team, position, depth_chart_rank,
      CAST(row_number() OVER (PARTITION BY season, recent_team ORDER BY
        list_position(['QB', 'RB', 'WR', 'TE'], position), coalesce(depth_chart_rank, 99),
        player_id, week) AS INTEGER) AS rank
    FROM gold""")
_MISS = "fantasy_points_3wk_avg - fantasy_points_ppr"
_MISS_COLUMNS = ("player_id, player_name, season, week, position, fantasy_points_ppr AS actual, "
                 "fantasy_points_3wk_avg AS predicted, week AS test_week, "
                 f"{_MISS} AS miss")
_KEYS = "player_id, player_name, season, week"
add("l8_biggest_misses", lambda d: E.biggest_misses(E.naive_form(d.gold)), f"""
    (SELECT {_MISS_COLUMNS}, 'over' AS direction FROM gold
     ORDER BY round({_MISS}, 9) DESC, {_KEYS} LIMIT 5)
    UNION ALL
    (SELECT {_MISS_COLUMNS}, 'under' FROM gold
     ORDER BY round({_MISS}, 9), {_KEYS} LIMIT 5)""", "actual predicted miss")


add("l10_season_list", lambda d: d.gold.select("season").distinct().orderBy("season"),
    "SELECT DISTINCT season FROM gold")

# --- set operations ------------------------------------------------------------

add("u1_role_union", lambda d: mentions(d).groupBy("player_id", "position").agg(
    F.count(F.lit(1)).alias("n")),
    "SELECT player_id, position, count(*) AS n FROM mentions GROUP BY ALL")
add("u2_home_away_union", lambda d: C.team_games(d.star.schedules).select(
    "season", "week", "team", "opponent", "is_home", "team_spread", "moneyline",
    "starting_qb_id"), """
    SELECT season, week, team, opponent, is_home, team_spread, moneyline, starting_qb_id
    FROM team_games""", "team_spread moneyline")


def _bypass(d: Domain):
    left = in_context(d).select("player_id", "season", "week", "gameday")
    ranked = J.asof_backward(left, FT.snapshot_ranks(d.star.depth_snapshots), "player_id",
                             "gameday", "snapshot_day", "rank_snapshot")
    return ranked.where(c("gameday").isNull()).select(*FT.PLAYER_WEEK, "rank_snapshot")


add("u3_bypass_rows", _bypass, """
    SELECT player_id, season, week, CAST(NULL AS INTEGER) AS rank_snapshot
    FROM players_in_context WHERE gameday IS NULL""")
def _fold_union(d: Domain):
    """The rows of each test week, united and scored."""
    weeks = sorted(r[0] for r in d.gold.select("week").distinct().collect())   # a calendar
    folds = [E.naive_form(d.gold.where(c("week") == w)) for w in weeks]
    return reduce(lambda a, b: a.unionByName(b), folds).groupBy("test_week").agg(
        F.avg(S.absolute_error("actual", "predicted")).alias("mae"))


add("u4_fold_union", _fold_union,
    f"SELECT week AS test_week, {_ERROR} AS mae FROM gold GROUP BY ALL", "mae")
add("u5_date_union", lambda d: C.last_game_dates(d.star.schedules, 3),
    "SELECT team, max(gameday) AS gameday FROM team_games WHERE week = 3 GROUP BY ALL")
add("u6_team_set", lambda d: V.slate_teams(d.predictions), """
    SELECT recent_team AS team FROM latest_slate WHERE recent_team IS NOT NULL
    UNION SELECT opponent FROM latest_slate WHERE opponent IS NOT NULL""")
