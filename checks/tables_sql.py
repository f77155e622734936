"""The domain tables as SQL common table expressions, for comparison runs.

Written independently of the DataFrame code: joins where that uses unions,
lists where that uses lags, and separate aggregates where that uses one pass.
"""

from __future__ import annotations

import re

from weekcast import schema
from weekcast.plans.features import ROLLING, rolling_name

TABLES: dict[str, str] = {}


def with_tables(body: str) -> str:
    """Prefix a SELECT with the tables it uses, directly or not."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(TABLES[name])

    visit(body)
    parts = [f"{n} AS ({TABLES[n].strip()})" for n in TABLES if n in used]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()


TABLES["ship_lines"] = """
SELECT *, CAST(year(l_shipdate) AS INTEGER) AS season,
       CAST(month(l_shipdate) AS INTEGER) AS week
FROM lineitem"""

TABLES["play_ids"] = """
SELECT l.*, s_nationkey, c_nationkey, p_size,
  CASE WHEN (l_returnflag = 'R' AND l_linenumber <> 7)
         OR (l_returnflag = 'N' AND l_linenumber = 2) THEN 'P' || l_suppkey END AS passer_player_id,
  CASE WHEN l_returnflag = 'A' THEN 'P' || l_suppkey END AS rusher_player_id,
  CASE WHEN l_returnflag = 'R' AND l_linenumber <> 1
       THEN 'P' || (l_partkey // 20 + 1) END AS receiver_player_id
FROM ship_lines l
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey"""

TABLES["plays"] = """
SELECT season, week,
  CASE l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'no_play' END AS play_type,
  'T' || s_nationkey AS posteam, 'T' || c_nationkey AS defteam,
  passer_player_id, 'Player ' || substr(passer_player_id, 2) AS passer_player_name,
  rusher_player_id, 'Player ' || substr(rusher_player_id, 2) AS rusher_player_name,
  receiver_player_id, 'Player ' || substr(receiver_player_id, 2) AS receiver_player_name,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS pass_attempt,
  CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS complete_pass,
  CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END AS rush_attempt,
  CASE WHEN l_discount <> 0 THEN l_quantity END AS yards_gained,
  CASE WHEN l_discount >= 0.09::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS pass_touchdown,
  CASE WHEN l_discount >= 0.09::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS rush_touchdown,
  CASE WHEN l_tax >= 0.08::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS interception,
  CASE WHEN l_tax = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS sack,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS qb_dropback,
  CAST(p_size AS DOUBLE) AS yardline_100,
  CASE WHEN receiver_player_id IS NOT NULL THEN l_extendedprice / 1000 END AS air_yards
FROM play_ids"""

TABLES["calendar"] = "SELECT DISTINCT season, week FROM ship_lines"

TABLES["nation_qb"] = """
SELECT s_nationkey, 'P' || min(s_suppkey) AS qb_id FROM supplier GROUP BY s_nationkey"""

TABLES["game_rows"] = """
SELECT season, week, n, 12 + (n + week) % 12 AS away,
  CASE WHEN (n + week) % 17 <> 0
       THEN CAST((13 * n + 7 * week + season) % 29 - 14 AS DOUBLE) / 2 END AS spread
FROM (SELECT season, week, unnest(range(12)) AS n FROM calendar)"""

TABLES["schedules"] = """
SELECT season, week,
  strftime(make_date(season, week, 1 + (7 * n + week) % 28), '%Y-%m-%d') AS gameday,
  'T' || n AS home_team, 'T' || away AS away_team, spread AS spread_line,
  35 + CAST((5 * n + 3 * week) % 40 AS DOUBLE) / 2 AS total_line,
  CASE WHEN spread > 0 THEN -(100 + 30 * spread) ELSE 100 - 30 * spread END AS home_moneyline,
  CASE WHEN spread > 0 THEN 100 + 30 * spread ELSE 30 * spread - 100 END AS away_moneyline,
  CASE n % 4 WHEN 0 THEN 'dome' WHEN 1 THEN 'closed' WHEN 2 THEN 'open' ELSE 'outdoors' END AS roof,
  CASE WHEN n % 4 >= 2 THEN CAST(20 + (11 * n + 5 * week) % 70 AS DOUBLE) END AS temp,
  CAST((3 * n + week) % 25 AS DOUBLE) AS wind,
  h.qb_id AS home_qb_id, a.qb_id AS away_qb_id
FROM game_rows
LEFT JOIN nation_qb h ON h.s_nationkey = n
LEFT JOIN nation_qb a ON a.s_nationkey = away"""

_POSITION = ("CASE l_suppkey % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' "
             "WHEN 3 THEN 'TE' WHEN 4 THEN 'FB' ELSE 'K' END")

TABLES["rosters"] = f"""
SELECT DISTINCT 'P' || l_suppkey AS player_id,
  CASE WHEN l_suppkey % 10 <> 0 THEN 'F' || l_suppkey END AS pfr_id,
  {_POSITION} AS position, season, 'T' || s_nationkey AS team,
  'Player ' || l_suppkey AS full_name
FROM ship_lines LEFT JOIN supplier ON l_suppkey = s_suppkey"""

TABLES["snap_counts"] = """
SELECT 'F' || l_suppkey AS pfr_player_id, season, week,
  CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS offense_pct
FROM ship_lines GROUP BY l_suppkey, season, week"""

TABLES["injuries"] = """
SELECT 'P' || l_suppkey AS gsis_id, season, week,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Out' WHEN '2-HIGH' THEN 'Doubtful'
       ELSE 'Questionable' END AS report_status
FROM (SELECT l_suppkey, season, week, min(l_orderkey) AS k FROM ship_lines GROUP BY ALL)
LEFT JOIN orders ON k = o_orderkey"""

TABLES["depth_weekly"] = f"""
SELECT DISTINCT 'P' || l_suppkey AS gsis_id, season, week,
  CASE WHEN l_suppkey % 13 = 0 THEN 'Defense' ELSE 'Offense' END AS formation,
  {_POSITION} AS position,
  CASE WHEN l_suppkey % 11 = 0 THEN 'x'
       ELSE CAST(1 + (l_suppkey + week) % 3 AS VARCHAR) END AS depth_team
FROM ship_lines WHERE season <= 1998"""

TABLES["depth_snapshots"] = f"""
SELECT 'P' || l_suppkey AS gsis_id,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS dt, o_orderdate AS dt_instant,
  {_POSITION} AS pos_abb, CAST(1 + l_orderkey % 3 AS INTEGER) AS pos_rank
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) > 1998"""

# --------------------------------------------------------------------------
# Box score and identity
# --------------------------------------------------------------------------

TABLES["pass_box"] = """
SELECT season, week, passer_player_id AS player_id, passer_player_name AS player_name,
  coalesce(sum(pass_attempt), 0) AS pass_attempts, coalesce(sum(complete_pass), 0) AS completions,
  coalesce(sum(yards_gained), 0) AS passing_yards, coalesce(sum(pass_touchdown), 0) AS passing_tds,
  coalesce(sum(interception), 0) AS interceptions
FROM plays WHERE play_type = 'pass' GROUP BY ALL"""

TABLES["rush_box"] = """
SELECT season, week, rusher_player_id AS player_id, rusher_player_name AS player_name,
  coalesce(sum(rush_attempt), 0) AS rush_attempts, coalesce(sum(yards_gained), 0) AS rushing_yards,
  coalesce(sum(rush_touchdown), 0) AS rushing_tds
FROM plays WHERE play_type = 'run' GROUP BY ALL"""

TABLES["recv_box"] = """
SELECT season, week, receiver_player_id AS player_id, receiver_player_name AS player_name,
  coalesce(sum(pass_attempt), 0) AS targets, coalesce(sum(complete_pass), 0) AS receptions,
  coalesce(sum(yards_gained), 0) AS receiving_yards, coalesce(sum(pass_touchdown), 0) AS receiving_tds
FROM plays WHERE play_type = 'pass' AND receiver_player_id IS NOT NULL GROUP BY ALL"""

TABLES["box_merged"] = """
SELECT coalesce(pr.season, c.season) AS season, coalesce(pr.week, c.week) AS week,
  coalesce(pr.player_id, c.player_id) AS player_id,
  coalesce(pr.player_name, c.player_name) AS player_name,
  pass_attempts, completions, passing_yards, passing_tds, interceptions,
  rush_attempts, rushing_yards, rushing_tds,
  targets, receptions, receiving_yards, receiving_tds
FROM (
  SELECT coalesce(p.season, r.season) AS season, coalesce(p.week, r.week) AS week,
    coalesce(p.player_id, r.player_id) AS player_id,
    coalesce(p.player_name, r.player_name) AS player_name,
    pass_attempts, completions, passing_yards, passing_tds, interceptions,
    rush_attempts, rushing_yards, rushing_tds
  FROM pass_box p FULL JOIN rush_box r ON p.season = r.season AND p.week = r.week
    AND p.player_id IS NOT DISTINCT FROM r.player_id
    AND p.player_name IS NOT DISTINCT FROM r.player_name) pr
FULL JOIN recv_box c ON pr.season = c.season AND pr.week = c.week
  AND pr.player_id IS NOT DISTINCT FROM c.player_id
  AND pr.player_name IS NOT DISTINCT FROM c.player_name"""

TABLES["box"] = "SELECT *, {} AS fantasy_points_ppr FROM (SELECT season, week, player_id, player_name, {} FROM box_merged)".format(
    "round_even(passing_yards * 0.04::DOUBLE + passing_tds * 4 + interceptions * -2"
    " + rushing_yards * 0.1::DOUBLE + rushing_tds * 6 + receiving_yards * 0.1::DOUBLE"
    " + receiving_tds * 6 + receptions * 1, 2)",
    ", ".join(f"coalesce({c}, 0) AS {c}" for c in schema.BOX_COLUMNS))

TABLES["mentions"] = """
SELECT passer_player_id AS player_id, passer_player_name AS player_name, posteam AS team,
       season, week, 'QB' AS position, 0 AS role_order
FROM plays WHERE passer_player_id IS NOT NULL
UNION ALL
SELECT rusher_player_id, rusher_player_name, posteam, season, week, 'RB', 1
FROM plays WHERE rusher_player_id IS NOT NULL
UNION ALL
SELECT receiver_player_id, receiver_player_name, posteam, season, week, 'WR', 2
FROM plays WHERE receiver_player_id IS NOT NULL"""

TABLES["modal_position"] = """
SELECT player_id, position FROM (
  SELECT player_id, position,
    row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, position) AS rn
  FROM mentions GROUP BY player_id, position) WHERE rn = 1"""

TABLES["first_name"] = """
SELECT player_id, player_name FROM (
  SELECT player_id, player_name, row_number() OVER (
    PARTITION BY player_id ORDER BY role_order, season, week, player_name) AS rn
  FROM mentions WHERE player_name IS NOT NULL) WHERE rn = 1"""

TABLES["official"] = """
SELECT player_id, position FROM (
  SELECT player_id, position, row_number() OVER (
    PARTITION BY player_id ORDER BY season DESC, position DESC) AS rn
  FROM rosters WHERE player_id IS NOT NULL AND position IS NOT NULL) WHERE rn = 1"""

TABLES["player_position"] = """
SELECT m.player_id, f.player_name,
  CASE WHEN o.position IN ('QB', 'RB', 'WR', 'TE') THEN o.position
       WHEN o.position = 'FB' THEN 'RB' ELSE m.position END AS position
FROM modal_position m LEFT JOIN first_name f USING (player_id)
LEFT JOIN official o USING (player_id)"""

TABLES["player_team"] = """
SELECT player_id, season, team AS recent_team FROM (
  SELECT player_id, season, team, row_number() OVER (
    PARTITION BY player_id, season ORDER BY week DESC, team DESC) AS rn
  FROM mentions WHERE team IS NOT NULL) WHERE rn = 1"""

TABLES["identified"] = """
SELECT b.* REPLACE (coalesce(b.player_name, p.player_name) AS player_name),
       p.position, t.recent_team
FROM box b JOIN player_position p ON b.player_id = p.player_id
LEFT JOIN player_team t ON b.player_id = t.player_id AND b.season = t.season"""

# --------------------------------------------------------------------------
# Context
# --------------------------------------------------------------------------

_PROB = ("coalesce(CASE WHEN {0} < 0 THEN -{0} / (-{0} + 100) ELSE 100 / ({0} + 100) END, 0.5::DOUBLE)")

TABLES["team_games"] = f"""
SELECT season, week, home_team AS team, away_team AS opponent, 1 AS is_home,
  CAST(gameday AS DATE) AS gameday, total_line / 2 + spread_line / 2 AS implied_total,
  spread_line AS team_spread, {_PROB.format('home_moneyline')} AS team_win_prob,
  home_qb_id AS starting_qb_id, temp, wind, roof, home_moneyline AS moneyline
FROM schedules
UNION ALL
SELECT season, week, away_team, home_team, 0,
  CAST(gameday AS DATE), total_line / 2 - spread_line / 2,
  0 - spread_line, {_PROB.format('away_moneyline')},
  away_qb_id, temp, wind, roof, away_moneyline
FROM schedules"""

TABLES["rested_games"] = """
SELECT *, date_diff('day', lag(gameday) OVER (
    PARTITION BY team, season ORDER BY gameday), gameday) AS days_since_last_game,
  CASE WHEN roof IN ('dome', 'closed') THEN 1 ELSE 0 END AS is_dome
FROM team_games"""

TABLES["games"] = """
SELECT g.season, g.week, g.team, g.opponent, g.gameday, g.implied_total, g.team_spread,
  g.team_win_prob, g.is_home, g.temp, g.wind,
  CASE WHEN (coalesce(g.wind > 15, false) OR coalesce(g.temp < 32, false)) AND g.is_dome = 0
       THEN 1 ELSE 0 END AS is_bad_weather,
  g.is_dome,
  CAST(coalesce(g.days_since_last_game - o.days_since_last_game, 0) AS DOUBLE) AS rest_advantage,
  g.starting_qb_id
FROM rested_games g LEFT JOIN rested_games o
  ON o.season = g.season AND o.week = g.week AND o.team = g.opponent"""

# --------------------------------------------------------------------------
# Team and player side tables
# --------------------------------------------------------------------------

_BEFORE = ("OVER (PARTITION BY {0} ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def shifted_ratio(num: str, den: str, entity: str) -> str:
    over = _BEFORE.format(f"{entity}, season")
    n, d = f"sum({num}) {over}", f"sum({den}) {over}"
    return f"coalesce(CASE WHEN {d} <> 0 THEN {n} / {d} END, 0)"


for _name, _team, _rate in [("offense_sacks", "posteam", "team_sack_rate_allowed"),
                            ("defense_sacks", "defteam", "opp_def_sack_rate")]:
    TABLES[_name] = f"""
SELECT {_team}, season, week, {shifted_ratio('sacks', 'dropbacks', _team)} AS {_rate}
FROM (SELECT {_team}, season, week, sum(qb_dropback) AS dropbacks, sum(sack) AS sacks
      FROM plays WHERE qb_dropback = 1 AND {_team} IS NOT NULL GROUP BY ALL)"""

TABLES["team_totals"] = """
SELECT posteam AS team, season, week,
  coalesce(sum(rush_attempt), 0) + coalesce(sum(pass_attempt), 0) AS team_total_opportunities,
  coalesce(sum(pass_attempt), 0) AS team_pass_attempts, sum(air_yards) AS team_air_yards
FROM plays WHERE posteam IS NOT NULL GROUP BY ALL"""

for _name, _types, _rate in [("rush_defense", "('run')", "opp_def_ypc_allowed"),
                             ("play_defense", "('run', 'pass')", "opp_def_ypp_allowed")]:
    TABLES[_name] = f"""
SELECT defteam, season, week, {shifted_ratio('yards', 'n', 'defteam')} AS {_rate}
FROM (SELECT defteam, season, week, coalesce(sum(yards_gained), 0) AS yards, count(*) AS n
      FROM plays WHERE play_type IN {_types} AND defteam IS NOT NULL GROUP BY ALL)"""

TABLES["hvt_runs"] = """
SELECT rusher_player_id AS player_id, season, week, count(*) AS hvt_carries FROM plays
WHERE play_type = 'run' AND yardline_100 <= 10 AND rusher_player_id IS NOT NULL GROUP BY ALL"""

TABLES["hvt_passes"] = """
SELECT receiver_player_id AS player_id, season, week, count(*) AS hvt_targets FROM plays
WHERE play_type = 'pass' AND yardline_100 <= 10 AND receiver_player_id IS NOT NULL GROUP BY ALL"""

TABLES["player_air"] = """
SELECT receiver_player_id AS player_id, season, week, sum(air_yards) AS player_air_yards
FROM plays WHERE receiver_player_id IS NOT NULL AND air_yards IS NOT NULL GROUP BY ALL"""

TABLES["snaps"] = """
SELECT player_id, s.season, s.week, max(offense_pct) AS snap_share
FROM snap_counts s JOIN (
  SELECT pfr_id, min(player_id) AS player_id FROM rosters
  WHERE pfr_id IS NOT NULL AND player_id IS NOT NULL GROUP BY pfr_id)
  ON pfr_player_id = pfr_id GROUP BY ALL"""

TABLES["weekly_rank"] = """
SELECT gsis_id AS player_id, season, week, min(TRY_CAST(depth_team AS INTEGER)) AS rank_weekly
FROM depth_weekly
WHERE formation = 'Offense' AND position IN ('QB', 'RB', 'WR', 'TE', 'FB') GROUP BY ALL"""

TABLES["snapshot_rank"] = """
SELECT gsis_id AS player_id, CAST(dt_instant AS DATE) AS snapshot_day,
       min(pos_rank) AS rank_snapshot
FROM depth_snapshots WHERE pos_abb IN ('QB', 'RB', 'WR', 'TE', 'FB') GROUP BY ALL"""

TABLES["out_reports"] = """
SELECT DISTINCT gsis_id AS player_id, season, week FROM injuries
WHERE report_status IN ('Out', 'Doubtful')"""

TABLES["players_in_context"] = """
SELECT i.*, g.* EXCLUDE (season, week, team)
FROM identified i LEFT JOIN games g
  ON g.season = i.season AND g.week = i.week AND g.team = i.recent_team"""

TABLES["defense_points"] = """
SELECT opponent, season, week, position,
  coalesce(sum(p) OVER w / nullif(row_number() OVER (
    PARTITION BY opponent, season, position ORDER BY week) - 1, 0), 0) AS opp_def_ppg_allowed
FROM (SELECT opponent, season, week, position, sum(fantasy_points_ppr) AS p
      FROM players_in_context WHERE opponent IS NOT NULL AND position IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY opponent, season, position ORDER BY week
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

_CUM = _BEFORE.format("player_id, season")
TABLES["qb_aya"] = f"""
SELECT player_id, season, week, coalesce(
  (sum(passing_yards) {_CUM} + 20 * sum(passing_tds) {_CUM} - 45 * sum(interceptions) {_CUM})
  / nullif(sum(pass_attempts) {_CUM}, 0), 0) AS starting_qb_aya
FROM identified WHERE pass_attempts > 0"""

TABLES["wr_grid"] = """
SELECT ps.player_id, ps.season, c.week, coalesce(f.targets, 0) AS targets
FROM (SELECT DISTINCT player_id, season FROM identified WHERE position = 'WR') ps
JOIN (SELECT DISTINCT season, week FROM identified) c ON c.season = ps.season
LEFT JOIN identified f ON f.player_id = ps.player_id AND f.season = ps.season AND f.week = c.week"""

TABLES["wr_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY recent_team, season, week
                             ORDER BY prior_targets DESC, player_id) AS wr_rank
FROM (
  SELECT g.player_id, g.season, g.week, t.recent_team,
    sum(targets) OVER (PARTITION BY g.player_id, g.season ORDER BY g.week) - targets AS prior_targets
  FROM wr_grid g LEFT JOIN player_team t ON g.player_id = t.player_id AND g.season = t.season)
WHERE recent_team IS NOT NULL"""

TABLES["wr_health"] = """
SELECT r.recent_team, r.season, r.week,
  CASE WHEN count(o.player_id) = 0 THEN 1 ELSE 0 END AS wr1_wr2_healthy
FROM wr_ranked r LEFT JOIN out_reports o
  ON o.player_id = r.player_id AND o.season = r.season AND o.week = r.week
WHERE wr_rank <= 2 GROUP BY ALL"""

# --------------------------------------------------------------------------
# Gold
# --------------------------------------------------------------------------

TABLES["shares"] = """
SELECT *, 1.5::DOUBLE * target_share + 0.7::DOUBLE * air_yards_share AS wopr FROM (
  SELECT *,
    coalesce(player_opportunities / nullif(team_total_opportunities, 0), 0) AS opportunity_share,
    coalesce(targets / nullif(team_pass_attempts, 0), 0) AS target_share,
    coalesce(player_air_yards / nullif(team_air_yards, 0), 0) AS air_yards_share
  FROM (
    SELECT p.*, rush_attempts + targets AS player_opportunities,
      team_total_opportunities, team_pass_attempts, team_air_yards,
      CAST(coalesce(hvt_carries, 0) AS DOUBLE) AS hvt_carries,
      CAST(coalesce(hvt_targets, 0) AS DOUBLE) AS hvt_targets,
      CAST(coalesce(hvt_carries, 0) + coalesce(hvt_targets, 0) AS DOUBLE) AS total_hvts,
      coalesce(player_air_yards, 0) AS player_air_yards, coalesce(snap_share, 0) AS snap_share
    FROM players_in_context p
    LEFT JOIN team_totals t ON t.team = p.recent_team AND t.season = p.season AND t.week = p.week
    LEFT JOIN hvt_runs r ON r.player_id = p.player_id AND r.season = p.season AND r.week = p.week
    LEFT JOIN hvt_passes h ON h.player_id = p.player_id AND h.season = p.season AND h.week = p.week
    LEFT JOIN player_air a ON a.player_id = p.player_id AND a.season = p.season AND a.week = p.week
    LEFT JOIN snaps s ON s.player_id = p.player_id AND s.season = p.season AND s.week = p.week))"""

_H = ", ".join(f"'{m}': {m}" for m in ROLLING)
TABLES["histories"] = f"""
SELECT *, list_filter(h, lambda x: x.s = season) AS cur,
          list_filter(h, lambda x: x.s = season - 1) AS prev
FROM (SELECT *, coalesce(list({{'s': season, {_H}}}) OVER (
        PARTITION BY player_id ORDER BY season, week
        ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), []) AS h FROM shares)"""


def last_of(items: str, n: str) -> str:
    return f"list_slice({items}, greatest(len({items}) - ({n}) + 1, 1), len({items}))"


def blend(metric: str, n: int, cur: str = "cur", prev: str = "prev") -> str:
    total = lambda items: f"list_sum(list_transform({items}, lambda x: x.{metric}))"
    mean = lambda items: f"{total(items)} / len({items})"
    tail = last_of(prev, f"{n} - len({cur})")
    return (
        f"CASE WHEN len({cur}) >= {n} THEN {mean(last_of(cur, str(n)))} "
        f"WHEN len({cur}) > 0 AND len({prev}) > 0 THEN ({total(cur)} + 0.3::DOUBLE * {total(tail)}) "
        f"/ (len({cur}) + 0.3::DOUBLE * len({tail})) "
        f"WHEN len({cur}) > 0 THEN {mean(cur)} "
        f"WHEN len({prev}) > 0 THEN {mean(last_of(prev, str(n)))} ELSE 0 END")


_ROLLED = []
for _m, (_, _positions) in ROLLING.items():
    for _n in schema.WINDOWS:
        _expr = blend(_m, _n)
        if _positions:
            _list = ", ".join(f"'{p}'" for p in _positions)
            _expr = f"CASE WHEN position IN ({_list}) THEN {_expr} ELSE 0 END"
        _ROLLED.append(f"{_expr} AS {rolling_name(_m, _n)}")

TABLES["season_totals"] = """
SELECT player_id, season + 1 AS season, avg(fantasy_points_ppr) AS prev_season_ppg,
       CAST(count(*) AS DOUBLE) AS prev_season_games
FROM identified GROUP BY ALL"""

TABLES["depth_ranked"] = """
SELECT player_id, season, week, coalesce(last_value(r IGNORE NULLS) OVER (
    PARTITION BY player_id, season ORDER BY week
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS depth_chart_rank
FROM (
  SELECT p.player_id, p.season, p.week, coalesce(w.rank_weekly, s.rank_snapshot) AS r
  FROM players_in_context p
  LEFT JOIN weekly_rank w ON w.player_id = p.player_id AND w.season = p.season AND w.week = p.week
  ASOF LEFT JOIN snapshot_rank s ON s.player_id = p.player_id AND s.snapshot_day <= p.gameday)"""

_FILL = set(schema.GOLD_FILL_ZERO)
_FROM = {
    **{c: f"h.{c}" for c in schema.ID_COLUMNS + schema.BOX_COLUMNS + schema.CONTEXT_COLUMNS
       + [schema.TARGET, "player_opportunities", "team_total_opportunities",
          "opportunity_share", "hvt_carries", "hvt_targets", "total_hvts", "snap_share",
          "team_pass_attempts", "target_share", "player_air_yards", "team_air_yards",
          "air_yards_share", "wopr"]},
    **{rolling_name(m, n): rolling_name(m, n) for m in ROLLING for n in schema.WINDOWS},
    "rolling_games_count": "len(cur)", "prev_season_ppg": "prev_season_ppg",
    "prev_season_games": "prev_season_games",
    "team_sack_rate_allowed": "team_sack_rate_allowed", "opp_def_sack_rate": "opp_def_sack_rate",
    "starting_qb_aya": "starting_qb_aya", "opp_def_ppg_allowed": "opp_def_ppg_allowed",
    "opp_def_ypc_allowed": "opp_def_ypc_allowed", "opp_def_ypp_allowed": "opp_def_ypp_allowed",
    "wr1_wr2_healthy": "coalesce(wr1_wr2_healthy, 1)", "depth_chart_rank": "depth_chart_rank",
}
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "date": "DATE"}
_SELECT = ", ".join(
    "CAST({} AS {}) AS {}".format(
        f"coalesce({_FROM[f.name]}, 0)" if f.name in _FILL else _FROM[f.name],
        _TYPES[f.dataType.simpleString()], f.name)
    for f in schema.GOLD.fields)

TABLES["gold_all"] = f"""
SELECT {_SELECT}
FROM (SELECT *, {', '.join(_ROLLED)} FROM histories) h
LEFT JOIN season_totals st ON st.player_id = h.player_id AND st.season = h.season
LEFT JOIN offense_sacks os ON os.posteam = h.recent_team AND os.season = h.season AND os.week = h.week
LEFT JOIN defense_sacks ds ON ds.defteam = h.opponent AND ds.season = h.season AND ds.week = h.week
LEFT JOIN qb_aya q ON q.player_id = h.starting_qb_id AND q.season = h.season AND q.week = h.week
LEFT JOIN defense_points dp ON dp.opponent = h.opponent AND dp.season = h.season
  AND dp.week = h.week AND dp.position = h.position
LEFT JOIN rush_defense rd ON rd.defteam = h.opponent AND rd.season = h.season AND rd.week = h.week
LEFT JOIN play_defense pd ON pd.defteam = h.opponent AND pd.season = h.season AND pd.week = h.week
LEFT JOIN wr_health wh ON wh.recent_team = h.recent_team AND wh.season = h.season AND wh.week = h.week
LEFT JOIN depth_ranked dr ON dr.player_id = h.player_id AND dr.season = h.season AND dr.week = h.week"""

# Plays without a player id: a box score and nothing that needs an identity.
_KNOWN = {c: c for c in ["player_id", "player_name", "season", "week", schema.TARGET]
          + schema.BOX_COLUMNS} | {
    "player_opportunities": "rush_attempts + targets", "rolling_games_count": "0",
    "wr1_wr2_healthy": "1", "depth_chart_rank": "9"} | {
    c: "0" for c in ("hvt_carries", "hvt_targets", "total_hvts", "player_air_yards", "wopr",
                     "opportunity_share", "target_share", "air_yards_share")}
_NOBODY = ", ".join("CAST({} AS {}) AS {}".format(
    _KNOWN.get(f.name, "0" if f.name in _FILL else "NULL"),
    _TYPES[f.dataType.simpleString()], f.name) for f in schema.GOLD.fields)

TABLES["gold"] = f"""
SELECT * FROM gold_all
WHERE NOT coalesce(position IN ('QB', 'TE'), false) OR depth_chart_rank = 1
UNION ALL BY NAME SELECT {_NOBODY} FROM box WHERE player_id IS NULL"""

# --------------------------------------------------------------------------
# Predictions derived from the last two slices of gold
# --------------------------------------------------------------------------

TABLES["last_slices"] = """
SELECT season, week, row_number() OVER (ORDER BY season DESC, week DESC) AS age
FROM (SELECT DISTINCT season, week FROM gold) QUALIFY age <= 2"""

_CONTEXT = ", ".join(
    f"CAST(g.{c} AS INTEGER) AS {c}" if c == "depth_chart_rank"
    else f"CAST(round(CAST(g.{c} AS DECIMAL(28, 9)), 4) AS DOUBLE) AS {c}" for c in schema.PREDICTION_CONTEXT)


def num(c: str, default: str = "0") -> str:
    return f"coalesce(CAST({c} AS DOUBLE), {default})"


def text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'None')"


TEMPLATE = f"""concat_ws(' ',
  {text('player_name')} || ' projects for ' || {text('projected_ppr')} || ' PPR points against '
    || {text('opponent')} || '.',
  'Vegas implies a ' || printf('%.1f', {num('implied_total')}) || '-point team total in a '
    || CASE WHEN {num('team_spread')} > 0 THEN 'favorable' ELSE 'tough' END || ' game script, '
    || CASE WHEN {num('fantasy_points_3wk_avg')} <> 0
       THEN 'and he has averaged ' || printf('%.1f', {num('fantasy_points_3wk_avg')})
            || ' points over the last three weeks.'
       ELSE 'with no in-season form yet (week 1).' END,
  CASE WHEN {num('is_bad_weather')} <> 0 THEN 'Bad weather is a downside risk for this game.'
       WHEN {num('opp_def_ppg_allowed')} <> 0 AND {num('opp_def_ppg_allowed')} < 15
       THEN 'Risk: ' || {text('opponent')} || ' has been stingy against ' || {text('position')}
            || 's (' || printf('%.1f', {num('opp_def_ppg_allowed')}) || ' PPR pts/game allowed).'
       WHEN {num('prev_season_ppg')} = 0
       THEN 'Risk: no prior-season scoring history (rookie or unranked).' END)"""

TABLES["prediction_base"] = f"""
SELECT g.player_id, g.player_name, g.position, g.recent_team, g.opponent, g.season, g.week,
  CASE WHEN g.position = 'QB' AND g.is_dome = 1 THEN NULL
       ELSE round_even(CAST(round(CAST(g.fantasy_points_5wk_avg AS DECIMAL(28, 9)), 4) AS DOUBLE), 1) END AS projected_ppr,
  CASE WHEN s.age IS NULL OR s.age > 1 THEN round_even(g.fantasy_points_ppr, 1) END AS actual_ppr,
  {_CONTEXT}
FROM gold g LEFT JOIN last_slices s ON g.season = s.season AND g.week = s.week"""

TABLES["predictions"] = f"""
SELECT *, CASE WHEN position = 'TE' THEN '' WHEN depth_chart_rank = 2 THEN NULL
               ELSE {TEMPLATE} END AS insight,
  'offline_template' AS insight_source
FROM prediction_base"""

TABLES["latest_slate"] = """
SELECT p.* FROM predictions p JOIN last_slices s
  ON p.season = s.season AND p.week = s.week AND age = 1"""
