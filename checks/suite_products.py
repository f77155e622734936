"""Evaluation, slates, serving queries and dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.suite import GOLD_DOUBLES, PREDICTION_DOUBLES, Domain, add
from checks.suite_operators import (
    CAREER, PASSED, SLATE_ROSTER, _LATEST, _MISS_COLUMNS, slate_roster_sql)
from checks.tables_sql import TEMPLATE, blend
from weekcast import schema
from weekcast.operators import aggregates as A
from weekcast.functions import scoring as S
from weekcast.operators.joins import same_rows
from weekcast.plans import boosting
from weekcast.plans import context as C
from weekcast.plans import evaluation as E
from weekcast.plans import features as FT
from weekcast.plans import serving as Q
from weekcast.plans import slate as SL
from weekcast.plans import views as V
from weekcast.session import new_path, stage
from weekcast.sources import sinks, tables

c = F.col
SEASON = 2001
# The first test week; the last one is the last week of the data.
TESTED = (9, None)
KEY = "player_id, player_name, season, week"

# --- splits -------------------------------------------------------------------


def _split(d: Domain, split):
    return d.gold.select(*E.ROW_KEY, split.alias("split"))


add("m1_static_split", lambda d: _split(d, E.static_split(SEASON, 6)), f"""
    SELECT {KEY}, CASE WHEN season < 2001 OR week <= 6 THEN 'train' ELSE 'test' END AS split
    FROM gold""")
add("m2_walk_forward_split", lambda d: _split(d, E.walk_forward_split(SEASON, 7)), f"""
    SELECT {KEY}, CASE WHEN season <> 2001 OR week <= 5 THEN 'train' WHEN week = 6 THEN 'val'
      WHEN week = 7 THEN 'test' END AS split FROM gold""")
add("m3_cold_start_split", lambda d: _split(d, E.cold_start_split(SEASON)), f"""
    SELECT {KEY}, CASE WHEN season = 2000 AND week = 1 THEN 'val' WHEN season < 2001 THEN 'train'
      WHEN week = 1 THEN 'test' END AS split FROM gold""")
add("m4_slate_split", lambda d: _split(d, E.slate_split(SEASON)), f"""
    SELECT {KEY}, CASE WHEN season = 2000 AND week = 1 THEN 'val' ELSE 'train' END AS split
    FROM gold""")

# --- models -------------------------------------------------------------------
# Predictions are learned and have no SQL. Beside each such query stands one that SQL can
# state: the same rows, and whether joins down the node table give the model's predictions.


def _frame(d: Domain):
    return d.once("frame", lambda: E.stored_frame(E.training_frame(d.gold)))


def _results(fitted: E.Fitted, rows):
    return fitted.predict(rows).select(
        *E.ROW_KEY, "position", c(E.TARGET).alias("actual"), c("prediction").alias("predicted"),
        c("week").alias("test_week"), F.lit(fitted.best_iteration).alias("best_iteration"))


def _agree(predicted, rows, model, models: dict[str, E.Fitted]):
    """Row key, position, actual, test week and whether both ways of scoring agree."""
    joined = boosting.score_by_joins(rows, E.ROW_KEY, model, models)
    same = F.coalesce(F.abs(c("predicted") - c("prediction")) < 1e-9, F.lit(False))
    return same_rows(predicted, joined, E.ROW_KEY).select(
        *E.ROW_KEY, "position", "actual", "test_week", same.alias("agrees"))


def _one_agrees(model):
    def run(d: Domain):
        fitted, rows = model(d)
        return _agree(_results(fitted, rows), rows, F.lit("m"), {"m": fitted})
    return run


def _agree_sql(where: str) -> str:
    return f"""SELECT {KEY}, position, fantasy_points_ppr AS actual, week AS test_week,
      TRUE AS agrees FROM gold WHERE {where}"""


def _fit(frame, split, params):
    return E.fit(frame, split, E.feature_names(), params), frame.where(split == "test")


def _static(d: Domain):
    return d.once("static", lambda: _fit(_frame(d), E.static_split(SEASON, 6), E.BASELINE))


def _early(d: Domain):
    return d.once("early", lambda: _fit(_frame(d), E.cold_start_split(SEASON), E.Params()))


add("m5_boosted_baseline", lambda d: _results(*_static(d)))
add("m5_node_table", _one_agrees(_static), _agree_sql("season = 2001 AND week > 6"), "actual")
add("m6_early_stopping", lambda d: _results(*_early(d)))
add("m6_node_table", _one_agrees(_early), _agree_sql("season = 2001 AND week = 1"), "actual")


def _feature_groups(d: Domain):
    lists = [F.struct(F.lit(p).alias("position"),
                      F.array(*map(F.lit, schema.SHARED_FEATURES + extra)).alias("features"))
             for p, extra in schema.POSITION_FEATURES.items()]
    rows = d.gold.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.select("position", "n", F.explode(F.array(*lists)).alias("g"))
    return groups.where(c("g.position") == c("position")).select(
        "position", "n", F.size("g.features").alias("features"))


add("m7_feature_groups", _feature_groups, """
    SELECT position, count(*) AS n, CAST(CASE position WHEN 'QB' THEN 25 WHEN 'RB' THEN 25
      WHEN 'WR' THEN 27 ELSE 26 END AS INTEGER) AS features FROM gold
    WHERE position IN ('QB', 'RB', 'WR', 'TE') GROUP BY position""")


def _walked(d: Domain, name: str, settings, weeks, groups=None):
    """Models of every fold, and their stored results."""
    def make():
        models = E.walk_models(_frame(d), settings, weeks, groups)
        return models, stage(E.walk_results(_frame(d), models), "walked")
    return d.once(name, make)


def _global_walk(d: Domain):
    return _walked(d, "global", {"": E.Params()}, TESTED)


def _position_walk(d: Domain):
    return _walked(d, "position", {"": E.Params()}, TESTED, E.position_features())


def _tuning(d: Domain):
    return _walked(d, "tuning", {str(i): p for i, p in enumerate(E.GRID)}, E.TUNE_WEEKS)


def _walk_agrees(walk):
    def run(d: Domain):
        models, results = walk(d)
        named = {"|".join(map(str, key)): m for key, ((_, m),) in models.items()}
        apart = all(group for group, *_ in models)
        of = F.concat_ws("|", c("position") if apart else F.lit(""), "season", "week")
        return _agree(results, _frame(d), of, named)
    return run


# Weeks that have a week before to stop on.
_TESTED_SQL = """season = 2001 AND week >= 9
      AND week - 1 IN (SELECT week FROM gold WHERE season = 2001)"""
add("m8_walk_forward_global", lambda d: _global_walk(d)[1].drop("setting"))
add("m8_global_node_table", _walk_agrees(_global_walk), _agree_sql(_TESTED_SQL), "actual")
add("m8_walk_forward_positions", lambda d: _position_walk(d)[1].drop("setting"))
add("m8_positions_node_table", _walk_agrees(_position_walk), _agree_sql(
    """season = 2001 AND week >= 9 AND position IN ('QB', 'RB', 'WR', 'TE')
      AND (position, week - 1) IN (SELECT (position, week) FROM gold WHERE season = 2001)
      AND (SELECT count(*) FROM gold o WHERE o.position = gold.position
           AND (o.season <> 2001 OR o.week <= gold.week - 2)) >= 50"""), "actual")
add("m9_grid_tuning", lambda d: E.tuned(_tuning(d)[1], E.GRID))


def _grid_rows(d: Domain):
    """What each setting was measured on."""
    results = _tuning(d)[1]
    counted = results.groupBy("setting").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("test_week").alias("folds"),
        F.sum("actual").alias("points"))
    rows = [(str(i), p.max_depth, p.learning_rate, p.min_child_weight)
            for i, p in enumerate(E.GRID)]
    return d.spark.createDataFrame(
        rows, "setting string, max_depth int, learning_rate double, min_child_weight int").join(
        counted, "setting").drop("setting")


add("m9_grid_folds", _grid_rows, """
    SELECT max_depth, learning_rate, min_child_weight, n, folds, points
    FROM (SELECT unnest([3, 4, 6]) AS max_depth),
      (SELECT unnest([0.03::DOUBLE, 0.05::DOUBLE]) AS learning_rate),
      (SELECT unnest([1, 5]) AS min_child_weight),
      (SELECT count(*) AS n, count(DISTINCT week) AS folds, sum(fantasy_points_ppr) AS points
       FROM gold WHERE season = 2001 AND week BETWEEN 5 AND 10
         AND week - 1 IN (SELECT week FROM gold WHERE season = 2001))""",
    "learning_rate points")


def _mean_round(d: Domain):
    """The mean early stop of the folds, against a plain mean over the models."""
    models, results = _global_walk(d)
    rounds = [m.best_iteration for ((_, m),) in models.values()]
    return E.mean_best_iteration(results).select(
        F.lit(len(rounds)).alias("folds"),
        (F.abs(c("mean_best_iteration") - sum(rounds) / len(rounds)) < 1e-9).alias("agrees"))


def _best_setting(d: Domain):
    """The chosen setting, and whether no setting has a smaller error."""
    tuning = stage(E.tuned(_tuning(d)[1], E.GRID), "tuning")
    best = E.best_params(tuning)
    mine = F.min(F.when((c("max_depth") == best.max_depth)
                        & (c("learning_rate") == best.learning_rate)
                        & (c("min_child_weight") == best.min_child_weight), c("tune_mae")))
    return tuning.agg(F.count(F.lit(1)).alias("settings"),
                      (mine == F.min("tune_mae")).alias("least"))


add("a32_mean_best_iteration", _mean_round, f"""
    SELECT CAST(count(DISTINCT week) AS INTEGER) AS folds, TRUE AS agrees FROM gold
    WHERE {_TESTED_SQL}""")
add("l9_best_setting", _best_setting, """
    SELECT count(*) AS settings, TRUE AS least
    FROM (SELECT unnest(range(3 * 2 * 2))) WHERE (SELECT count(*) FROM gold) > 0""")
for _name, _make, _sql in [
        ("form", E.naive_form, "fantasy_points_3wk_avg"),
        ("last_season", E.naive_previous_season, "greatest(prev_season_ppg, 0)")]:
    add(f"m10_naive_{_name}", lambda d, make=_make: make(d.gold), f"""
        SELECT {KEY}, position, fantasy_points_ppr AS actual, {_sql} AS predicted,
          week AS test_week FROM gold""", "actual predicted")
add("m10_naive_mean", lambda d: E.naive_training_mean(
    d.gold.where("season = 2001 AND week = 1"), d.gold.where("season < 2001")).select(
    *E.ROW_KEY, "actual", "predicted"), f"""
    SELECT {KEY}, fantasy_points_ppr AS actual,
      (SELECT avg(fantasy_points_ppr) FROM gold WHERE season < 2001) AS predicted
    FROM gold WHERE season = 2001 AND week = 1""", "actual predicted")
_ERR = "round_even(avg(abs(fantasy_points_ppr - {})), 2)"
add("m11_naive_comparison", lambda d: E.compare({
    "form": E.naive_form(d.gold), "last_season": E.naive_previous_season(d.gold)}), """
    SELECT position, {0} AS form, {1} AS last_season FROM gold GROUP BY position
    UNION ALL SELECT 'OVERALL', {0}, {1} FROM gold""".format(
        _ERR.format("fantasy_points_3wk_avg"), _ERR.format("greatest(prev_season_ppg, 0)")),
    "form last_season")


def _three_models(d: Domain):
    """Naive form, the global model and the models per position on the same test rows."""
    return {"form": E.naive_form(_frame(d).where(c("season") == SEASON)),
            "global_model": _global_walk(d)[1], "position_models": _position_walk(d)[1]}


def _common_rows(d: Domain):
    """Rows that all three predicted, and the naive error on them, per position and overall."""
    models = _three_models(d)
    common = models["form"].select(*E.ROW_KEY, "position", "actual", "predicted")
    for name in ("global_model", "position_models"):
        common = same_rows(common, models[name].select(*E.ROW_KEY), E.ROW_KEY)
    measures = [F.count(F.lit(1)).alias("n"),
                S.round_even(F.avg(S.absolute_error("actual", "predicted")), 2).alias("form")]
    return common.groupBy("position").agg(*measures).unionByName(
        common.agg(*measures).withColumn("position", F.lit("OVERALL")))


add("m11_model_comparison", lambda d: E.compare(_three_models(d)))
add("m11_common_rows", _common_rows, """
    WITH tested AS (SELECT * FROM gold WHERE season = 2001 AND week >= 9
        AND position IN ('QB', 'RB', 'WR', 'TE')
        AND (position, week - 1) IN (SELECT (position, week) FROM gold WHERE season = 2001)
        AND (SELECT count(*) FROM gold o WHERE o.position = gold.position
             AND (o.season <> 2001 OR o.week <= gold.week - 2)) >= 50)
    SELECT position, count(*) AS n, {0} AS form FROM tested GROUP BY position
    UNION ALL SELECT 'OVERALL', count(*), {0} FROM tested""".format(
        _ERR.format("fantasy_points_3wk_avg")), "form")
add("m12_importance", lambda d: _static(d)[0].importance(d.spark, 10))


def _importance_agrees(d: Domain):
    fitted = _static(d)[0]
    shown = fitted.importance(d.spark, len(fitted.features)).withColumnRenamed("importance", "told")
    return boosting.gains_by_nodes(d.spark, fitted).join(shown, "feature").select(
        "feature", (F.abs(c("importance") - c("told")) < 1e-9).alias("agrees"))


add("m12_node_table", _importance_agrees, """
    SELECT column_name AS feature, TRUE AS agrees FROM (
      SELECT unnest([{}]) AS column_name) WHERE (SELECT count(*) FROM gold) > 0""".format(
    ", ".join(f"'{f}'" for f in E.feature_names())))
add("m13_forward_slate", lambda d: A.latest_slice(d.predictions).withColumn(
    "forward", F.lit(int(E.is_forward_slate(d.gold, d.predictions)))), """
    SELECT season, week, CAST((SELECT count(*) FROM predictions p JOIN last_slices s
        ON p.season = s.season AND p.week = s.week AND age = 1)
      > (SELECT count(*) FROM gold g JOIN last_slices s
        ON g.season = s.season AND g.week = s.week AND age = 1) AS INTEGER) AS forward
    FROM last_slices WHERE age = 1""")
def _latest(d: Domain):
    return d.once("latest", lambda: E.latest_model(d.gold, E.Params()))


def _latest_rows(d: Domain):
    fitted, rows = _latest(d)
    return E.prediction_rows(Q.in_latest_slice(d.gold), fitted.predict(rows).select(
        *E.ROW_KEY, "prediction"))


add("m14_predict_latest", _latest_rows)
add("m14_node_table", _one_agrees(_latest), f"""
    SELECT {KEY.replace('season, week', 'g.season, g.week')}, position,
      fantasy_points_ppr AS actual, g.week AS test_week, TRUE AS agrees
    FROM gold g JOIN last_slices s ON g.season = s.season AND g.week = s.week AND age = 1""",
    "actual")


def _prediction_rows(d: Domain):
    newest = Q.in_latest_slice(d.gold)
    scored = newest.select(*E.ROW_KEY, (c("fantasy_points_3wk_avg") - 5).alias("prediction"))
    return E.prediction_rows(newest, scored).select(
        "player_id", "season", "week", "projected_ppr", "actual_ppr", "is_home", "temp",
        "depth_chart_rank")


add("m14_prediction_columns", _prediction_rows, """
    SELECT g.player_id, g.season, g.week,
      round_even(greatest(fantasy_points_3wk_avg - 5, 0), 1) AS projected_ppr,
      round_even(fantasy_points_ppr, 1) AS actual_ppr, is_home, temp, depth_chart_rank
    FROM gold g JOIN last_slices s ON g.season = s.season AND g.week = s.week AND age = 1""",
    "projected_ppr actual_ppr is_home temp depth_chart_rank")

# --- slates -------------------------------------------------------------------

SLATE_CONTEXT = """(SELECT g.team, g.opponent, g.is_home,
      coalesce(s.total_line, 44.0) / 2 + coalesce(g.team_spread, 0) / 2 AS implied_total,
      coalesce(g.team_spread, 0) AS team_spread,
      CASE WHEN moneyline IS NULL THEN 0.5::DOUBLE WHEN moneyline > 0 THEN 100 / (moneyline + 100)
           ELSE abs(moneyline) / (abs(moneyline) + 100) END AS team_win_prob,
      CASE WHEN g.roof IN ('dome', 'closed') THEN 1 ELSE 0 END AS is_dome,
      72.0::DOUBLE AS temp, 0.0::DOUBLE AS wind, 0 AS is_bad_weather,
      CAST(g.team_spread IS NULL AS INTEGER) AS missing_vegas_lines,
      CAST(coalesce(r.rest - o.rest, 0) AS DOUBLE) AS rest_advantage
    FROM team_games g
    JOIN schedules s ON s.season = g.season AND s.week = g.week
      AND g.team = CASE WHEN g.is_home = 1 THEN s.home_team ELSE s.away_team END
    LEFT JOIN {rest} r ON r.team = g.team LEFT JOIN {rest} o ON o.team = g.opponent
    WHERE g.season = 2001 AND g.week = {week})"""
_REST = """(SELECT b.team, date_diff('day', max(a.gameday), max(b.gameday)) AS rest
      FROM team_games a JOIN team_games b ON a.team = b.team AND a.season = 2001
        AND b.season = 2001 AND a.week = {week} - 1 AND b.week = {week} GROUP BY b.team)"""


def slate_context_sql(week: int) -> str:
    return SLATE_CONTEXT.format(week=week, rest=_REST.format(week=week))


_CONTEXT_DOUBLES = "implied_total team_spread team_win_prob temp wind rest_advantage"
add("g1_future_context", lambda d: C.slate_context(d.star.schedules, SEASON, 2),
    f"SELECT * FROM {slate_context_sql(2)}", _CONTEXT_DOUBLES)
add("g2_rest_from_previous_week", lambda d: C.rest_days(
    d.star.schedules.where(c("season") == SEASON), 2),
    f"SELECT team, CAST(rest AS INTEGER) AS rest_days FROM {_REST.format(week=2)}")
add("g3_eligible_roster", lambda d: SL.eligible_roster(
    d.star.rosters, d.star.depth_snapshots, SEASON), f"SELECT * FROM {slate_roster_sql()}")
add("g4_starter_filter", lambda d: FT.starters_only(d.unfiltered_gold).select(
    *FT.PLAYER_WEEK, "position", "depth_chart_rank"),
    "SELECT player_id, season, week, position, depth_chart_rank FROM gold "
    "WHERE player_id IS NOT NULL")
add("g5_carryover_all_weeks", lambda d: SL.carryover(d.gold, SEASON), """
    SELECT player_id, avg(fantasy_points_ppr) AS prev_season_ppg,
      CAST(count(*) AS DOUBLE) AS prev_season_games FROM gold WHERE season = 2000 GROUP BY ALL""",
    "prev_season_ppg prev_season_games")


def _slate_keys(d: Domain):
    return d.star.rosters.where(c("season") == SEASON).select("player_id")


_NAMES = [FT.rolling_name(m, n) for m in FT.ROLLING for n in schema.WINDOWS]
_PACK = ", ".join(f"'{m}': {m}" for m in FT.ROLLING)
_SLATE_HISTORY = f"""(SELECT player_id,
      list_filter(h, lambda x: x.s = 2001) AS cur, list_filter(h, lambda x: x.s = 2000) AS prev
    FROM (SELECT r.player_id, coalesce(h, []) AS h
      FROM (SELECT player_id FROM rosters WHERE season = 2001) r
      LEFT JOIN (SELECT player_id, list({{'s': season, {_PACK}}} ORDER BY season, week) AS h
        FROM gold WHERE season = 2000 OR (season = 2001 AND week < 2) GROUP BY player_id) g
      ON g.player_id = r.player_id))"""


def _form_sql(zero: bool) -> str:
    parts = []
    for m in FT.ROLLING:
        for n in schema.WINDOWS:
            e = blend(m, n)
            parts.append(f"{f'CASE WHEN len(cur) = 0 THEN 0 ELSE {e} END' if zero else e} "
                         f"AS {FT.rolling_name(m, n)}")
    return (f"SELECT player_id, {', '.join(parts)}, CAST(len(cur) AS INTEGER) "
            f"AS rolling_games_count FROM {_SLATE_HISTORY}")


for _cold, _id in [("blend", "g6_slate_form"), ("zero", "g7_zero_cold_start")]:
    add(_id, lambda d, cold=_cold: SL.with_form(_slate_keys(d), d.gold, SEASON, 2, cold),
        _form_sql(_cold == "zero"), " ".join(_NAMES))


def _slate(d: Domain, cold="blend"):
    return SL.build_slate(d.gold, d.star.schedules, d.star.rosters, d.star.depth_snapshots,
                          SEASON, 2, cold)


add("g8_starting_qb", lambda d: _slate(d).select(
    "player_id", "recent_team", "position", "starting_qb_id", "starting_qb_aya"),
    PASSED, "starting_qb_aya")
add("g9_neutral_fills", lambda d: _slate(d).select(
    "player_id", *SL.PLAY_BASED_RATES, "wr1_wr2_healthy"),
    "SELECT e.player_id, {}, 1 AS wr1_wr2_healthy FROM {} e JOIN {} g ON g.team = e.team".format(
        ", ".join(f"0.0::DOUBLE AS {x}" for x in SL.PLAY_BASED_RATES), SLATE_ROSTER,
        slate_context_sql(2)), " ".join(SL.PLAY_BASED_RATES))
_SLATE_FIELDS = ["player_id", "player_name", "recent_team", "position", "opponent", "season",
                 "week", *schema.PREDICTION_CONTEXT, "missing_vegas_lines", "rest_advantage",
                 "prev_season_games", "rolling_games_count"]
SLATE_SQL = f"""SELECT e.player_id, e.player_name, e.team AS recent_team, e.position, g.opponent,
      2001 AS season, 2 AS week, g.implied_total, g.team_spread, g.team_win_prob, g.is_home,
      g.temp, g.wind, g.is_bad_weather, g.is_dome, f.fantasy_points_3wk_avg, e.depth_chart_rank,
      coalesce(a.points, 0) AS opp_def_ppg_allowed, coalesce(p.ppg, 0) AS prev_season_ppg,
      g.missing_vegas_lines, g.rest_advantage, coalesce(p.games, 0) AS prev_season_games,
      f.rolling_games_count
    FROM {SLATE_ROSTER} e JOIN {slate_context_sql(2)} g ON g.team = e.team
    LEFT JOIN ({_form_sql(False)}) f ON f.player_id = e.player_id
    LEFT JOIN (SELECT player_id, avg(fantasy_points_ppr) AS ppg, CAST(count(*) AS DOUBLE) AS games
      FROM gold WHERE season = 2000 AND week <= 17 GROUP BY ALL) p ON p.player_id = e.player_id
    LEFT JOIN (SELECT opponent, position, avg(fantasy_points_ppr) AS points FROM gold
      WHERE season = 2001 AND week < 2 GROUP BY ALL) a
      ON a.opponent = g.opponent AND a.position = e.position"""
_SLATE_DOUBLES = ("implied_total team_spread team_win_prob temp wind fantasy_points_3wk_avg "
                  "opp_def_ppg_allowed prev_season_ppg rest_advantage prev_season_games")
add("g10_slate_features", lambda d: _slate(d).select(*_SLATE_FIELDS), SLATE_SQL, _SLATE_DOUBLES)


def _slate_written(d: Domain):
    """The slate, scored by its own form, replacing one slice of the history."""
    path = new_path(d.spark, "slate")
    sinks.rebuild(d.predictions, path)
    scored = _slate(d).withColumn("prediction", c("fantasy_points_3wk_avg"))
    out = SL.slate_output(scored)
    sinks.replace_slice(SL.to_predictions(out), path, SEASON, 2)
    return tables.read_predictions(d.spark, path).where(
        (c("season") == SEASON) & (c("week") == 2))


add("g10_slate_output", _slate_written, f"""
    SELECT player_id, player_name, position, recent_team, opponent, season, week,
      round_even(greatest(fantasy_points_3wk_avg, 0), 1) AS projected_ppr,
      CAST(NULL AS DOUBLE) AS actual_ppr,
      {', '.join(f'CAST({x} AS {"INTEGER" if x == "depth_chart_rank" else "DOUBLE"}) AS {x}'
                 for x in schema.PREDICTION_CONTEXT)},
      CAST(NULL AS VARCHAR) AS insight, CAST(NULL AS VARCHAR) AS insight_source
    FROM ({SLATE_SQL})""", PREDICTION_DOUBLES)


def _slate_model(d: Domain):
    """The slate as the model reads it, and the model."""
    def make():
        fitted = E.fit(E.stored_frame(E.training_frame(SL.before(d.gold, SEASON, 2))),
                       E.slate_split(SEASON), E.feature_names(), E.Params())
        slate = E.one_hot(_slate(d))
        names = [n for n in E.feature_names() if n not in ("season", "week")]
        kept = [x for x in slate.columns if x not in names]
        return fitted, stage(slate.select(*kept, *E.align(slate, names)), "slate")
    return d.once("slate", make)


def _slate_scored(d: Domain):
    fitted, slate = _slate_model(d)
    names = [n for n in E.feature_names() if n not in ("season", "week")]
    return SL.slate_output(fitted.predict(slate).drop(
        *[n for n in names if n not in SL.OUTPUT_CONTEXT]))


def _slate_agrees(d: Domain):
    fitted, slate = _slate_model(d)
    joined = boosting.score_by_joins(slate, E.ROW_KEY, F.lit("m"), {"m": fitted})
    scored = fitted.predict(slate).select(*E.ROW_KEY, "position", c("prediction").alias("told"))
    return same_rows(scored, joined, E.ROW_KEY).select(
        *E.ROW_KEY, "position", (F.abs(c("told") - c("prediction")) < 1e-9).alias("agrees"))


add("g10_slate_scored", _slate_scored)
add("g10_slate_node_table", _slate_agrees, f"""
    SELECT {KEY}, position, TRUE AS agrees FROM ({SLATE_SQL})""")
add("g10_slate_report", lambda d: SL.slate_report(_slate(d)), f"""
    SELECT s.position, count(*) AS players,
      CAST(sum(missing_vegas_lines) AS BIGINT) AS missing_lines,
      count(*) FILTER (f.fantasy_points_3wk_avg <> 0) AS nonzero_fantasy_points_3wk_avg,
      count(*) FILTER (rb_opportunity_share_3wk_avg <> 0) AS nonzero_rb_opportunity_share_3wk_avg,
      count(*) FILTER (wr_te_target_share_3wk_avg <> 0) AS nonzero_wr_te_target_share_3wk_avg
    FROM ({SLATE_SQL}) s JOIN ({_form_sql(False)}) f ON f.player_id = s.player_id
    GROUP BY s.position""")
add("g10_opening_slate", lambda d: SL.build_opening_slate(
    d.gold, d.star.schedules, d.star.rosters, d.star.depth_snapshots, SEASON).select(
    "player_id", "recent_team", "opponent", "week", "prev_season_ppg", "prev_season_games",
    "fantasy_points_3wk_avg", "rolling_games_count", "opp_def_ppg_allowed", "wr1_wr2_healthy"),
    f"""SELECT e.player_id, e.team AS recent_team, g.opponent, 1 AS week,
      coalesce(ppg, 0) AS prev_season_ppg, coalesce(games, 0) AS prev_season_games,
      0.0::DOUBLE AS fantasy_points_3wk_avg, 0 AS rolling_games_count,
      0.0::DOUBLE AS opp_def_ppg_allowed, 0 AS wr1_wr2_healthy
    FROM {slate_roster_sql(1)} e JOIN team_games g ON g.team = e.team AND g.season = 2001 AND g.week = 1
    LEFT JOIN (SELECT player_id, avg(fantasy_points_ppr) AS ppg, CAST(count(*) AS DOUBLE) AS games
      FROM gold WHERE season = 2000 GROUP BY ALL) p ON p.player_id = e.player_id""",
    "prev_season_ppg prev_season_games fantasy_points_3wk_avg opp_def_ppg_allowed")

# --- serving queries ------------------------------------------------------------

PLAYER = "P7"
_GOLD = ", ".join(schema.GOLD_COLUMNS)
_PRED = ", ".join(f.name for f in schema.PREDICTIONS.fields)


def _total(source: str) -> str:
    return f"CAST((SELECT count(*) FROM {source}) AS INTEGER) AS total"


_LIST = f"""(SELECT player_id, player_name, position, recent_team, season AS latest_season,
      week AS latest_week, opponent AS latest_opponent, fantasy_points_ppr AS latest_ppr
    FROM (SELECT * FROM gold {_LATEST}) WHERE position = 'RB')"""
add("q1_list_players", lambda d: Q.list_players(d.gold, position="rb", limit=20, offset=5), f"""
    SELECT *, {_total(_LIST)} FROM {_LIST} ORDER BY player_name NULLS FIRST, player_id
    LIMIT 20 OFFSET 5""", "latest_ppr")
add("q2_get_player", lambda d: Q.get_player(d.gold, PLAYER).select(
    *schema.GOLD_COLUMNS, "games_played", "first_season", "last_season", "career_ppg",
    "career_high"), f"""
    SELECT {_GOLD}, games_played, first_season, last_season, career_ppg, career_high
    FROM (SELECT * FROM gold WHERE player_id = '{PLAYER}' {_LATEST}) g
    JOIN ({CAREER}) c USING (player_id)""", f"{GOLD_DOUBLES} career_ppg career_high")
add("q2_all_players", lambda d: A.keep_one(
    d.gold, ["player_id"], [F.desc("season"), F.desc("week"), F.asc("player_name")]).join(
    Q.career(d.gold), "player_id").select(
    "player_id", "recent_team", "season", "week", "games_played", "career_ppg"), f"""
    SELECT player_id, recent_team, season, week, games_played, career_ppg
    FROM (SELECT * FROM gold {_LATEST}) JOIN ({CAREER}) USING (player_id)""", "career_ppg")
add("q3_player_history", lambda d: Q.player_history(d.gold, PLAYER, limit=30).select(
    *schema.GOLD_COLUMNS, "total"), f"""
    SELECT {_GOLD}, {_total(f"gold WHERE player_id = '{PLAYER}'")} FROM gold
    WHERE player_id = '{PLAYER}' ORDER BY season DESC, week DESC, player_name LIMIT 30""",
    GOLD_DOUBLES)
add("q4_latest_predictions", lambda d: Q.latest_predictions(
    d.table("predictions"), d.newest("predictions")),
    f"SELECT {_PRED} FROM latest_slate", PREDICTION_DOUBLES)
_FILTERED = "latest_slate WHERE position = 'RB' AND projected_ppr >= 5"
add("q5_list_predictions", lambda d: Q.list_predictions(
    d.predictions, position="RB", min_projected=5, limit=10, offset=2), f"""
    SELECT {_PRED}, {_total(_FILTERED)} FROM {_FILTERED}
    ORDER BY projected_ppr DESC NULLS LAST, player_id LIMIT 10 OFFSET 2""", PREDICTION_DOUBLES)
add("q6_top_predictions", lambda d: Q.top_predictions(d.predictions, 10), f"""
    SELECT {_PRED}, {_total('latest_slate')} FROM latest_slate
    ORDER BY projected_ppr DESC NULLS LAST, player_id LIMIT 10""", PREDICTION_DOUBLES)
add("q7_get_prediction", lambda d: Q.get_prediction(d.predictions, PLAYER), f"""
    SELECT {_PRED} FROM predictions WHERE player_id = '{PLAYER}'
    ORDER BY season DESC, week DESC LIMIT 1""", PREDICTION_DOUBLES)
_NEWEST = ("(SELECT g.* FROM gold g JOIN last_slices s ON g.season = s.season "
           "AND g.week = s.week AND age = 1)")
add("q8_latest_week", lambda d: Q.latest_week(
    d.table("gold"), limit=25, newest=d.newest("gold")).select(
    *schema.GOLD_COLUMNS, "total"), f"""
    SELECT {_GOLD}, {_total(_NEWEST)} FROM {_NEWEST}
    ORDER BY fantasy_points_ppr DESC, player_id LIMIT 25""", GOLD_DOUBLES)
_WEEK = "gold WHERE season = 1999 AND week = 4 AND position = 'WR'"
add("q9_week_stats", lambda d: Q.week_stats(d.gold, 1999, 4, position="wr", limit=15).select(
    *schema.GOLD_COLUMNS, "total"), f"""
    SELECT {_GOLD}, {_total(_WEEK)} FROM {_WEEK}
    ORDER BY fantasy_points_ppr DESC, player_id LIMIT 15""", GOLD_DOUBLES)
ROSTER = f"""SELECT r.player_id, r.player_name, r.position, r.recent_team,
      coalesce(p.opponent, r.opponent) AS opponent, coalesce(p.season, r.season) AS season,
      coalesce(p.week, r.week) AS week, p.projected_ppr, p.actual_ppr, p.insight,
      p.insight_source, r.fantasy_points_ppr AS latest_ppr,
      coalesce(p.depth_chart_rank, r.depth_chart_rank) AS depth_chart_rank
    FROM (SELECT * FROM gold WHERE recent_team = '{{team}}' {_LATEST}) r
    LEFT JOIN latest_slate p ON p.player_id = r.player_id"""
add("q10_team_roster", lambda d: Q.team_roster(d.gold, d.predictions, "T9"),
    ROSTER.format(team="T9"), "projected_ppr actual_ppr latest_ppr")

# --- dashboard views --------------------------------------------------------------

_SHOWN = """(SELECT * REPLACE (CASE WHEN position IN ('QB', 'RB', 'WR', 'TE') THEN position
      ELSE 'WR' END AS position, coalesce(projected_ppr, 0) AS projected_ppr) FROM latest_slate)"""
_NOTE = ("CASE WHEN is_dome = 1 THEN 'dome' WHEN is_bad_weather = 1 THEN 'weather' END "
         "AS venue_note")
add("v1_rankings", lambda d: V.rankings(
    d.table("predictions"), key="opp_def_ppg_allowed", min_projected=1.0,
    newest=d.newest("predictions")), f"""
    SELECT {_PRED}, {_NOTE}, {_total(f'{_SHOWN} WHERE projected_ppr >= 1')} FROM {_SHOWN}
    WHERE projected_ppr >= 1 ORDER BY opp_def_ppg_allowed DESC NULLS LAST, player_id LIMIT 50""",
    PREDICTION_DOUBLES)
add("v1_ranking_teams", lambda d: V.ranking_teams(d.predictions),
    "SELECT DISTINCT recent_team FROM latest_slate")
add("v2_slate_summary", lambda d: V.slate_summary(d.predictions), f"""
    SELECT CAST(count(*) AS INTEGER) AS players,
      (SELECT CAST(floor(count(*) / 2 + 0.5) AS INTEGER) FROM (
        SELECT recent_team AS t FROM latest_slate WHERE recent_team IS NOT NULL
        UNION SELECT opponent FROM latest_slate WHERE opponent IS NOT NULL)) AS games,
      CAST(count(*) FILTER (length(trim(insight)) > 0) AS INTEGER) AS insights,
      max(projected_ppr) AS top_projection FROM {_SHOWN}""", "top_projection")
_MATCHUP = ("CASE WHEN coalesce(is_home, 0) <> 0 THEN 'vs' ELSE '@' END "
            "|| coalesce(' ' || opponent, '') AS matchup")
add("v2_slate_top", lambda d: V.slate_top(d.predictions), f"""
    SELECT CAST(row_number() OVER (ORDER BY projected_ppr DESC, player_id) AS INTEGER) AS rank,
      player_id, player_name, position, recent_team, {_MATCHUP}, projected_ppr, actual_ppr,
      actual_ppr - projected_ppr AS delta, fantasy_points_3wk_avg,
      CASE WHEN projected_ppr >= fantasy_points_3wk_avg THEN 'up'
           WHEN projected_ppr < fantasy_points_3wk_avg THEN 'down' END AS trend
    FROM {_SHOWN} QUALIFY rank <= 10""",
    "projected_ppr actual_ppr delta fantasy_points_3wk_avg")
add("v2_slate_insights", lambda d: V.slate_insights(d.predictions), f"""
    SELECT player_id, player_name, projected_ppr, insight, CAST(row_number() OVER (
      ORDER BY projected_ppr DESC, player_id) = 1 AS INTEGER) AS featured
    FROM {_SHOWN} WHERE length(trim(insight)) > 0""", "projected_ppr")


add("v3_results", lambda d: V.results(d.predictions), f"""
    SELECT season, week, CAST(row_number() OVER (PARTITION BY season, week
        ORDER BY actual_ppr DESC, player_id NULLS FIRST) AS INTEGER) AS rank, player_id,
      player_name, CASE WHEN position IN ('QB', 'RB', 'WR', 'TE') THEN position ELSE 'WR' END
        AS position, recent_team, {_MATCHUP}, actual_ppr,
      coalesce(projected_ppr, 0) AS projected_ppr,
      actual_ppr - coalesce(projected_ppr, 0) AS delta
    FROM (SELECT p.* FROM predictions p JOIN last_slices s
      ON p.season = s.season AND p.week = s.week AND age = 2)""",
    "actual_ppr projected_ppr delta")
add("v4_team_depth", lambda d: V.team_depth(d.gold, d.predictions, "T9"), f"""
    SELECT position, CAST(count(*) OVER (PARTITION BY position) AS INTEGER) AS on_roster,
      depth_chart_rank, player_id, player_name, projected_ppr, actual_ppr, opponent
    FROM ({ROSTER.format(team='T9')}) WHERE position IN ('QB', 'RB', 'WR', 'TE')""",
    "projected_ppr actual_ppr")
add("v5_season_log", lambda d: V.season_log(d.gold, PLAYER), f"""
    SELECT season, week, opponent, CAST(floor(snap_share * 100 + 0.5) AS INTEGER) AS snap_pct,
      targets, air_yards_share, wopr, fantasy_points_ppr AS ppr FROM gold
    WHERE player_id = '{PLAYER}' AND season = (SELECT max(season) FROM gold
      WHERE player_id = '{PLAYER}')""", "targets air_yards_share wopr ppr")
add("v5_player_seasons", lambda d: V.player_seasons(d.gold, PLAYER),
    f"SELECT DISTINCT season FROM gold WHERE player_id = '{PLAYER}'")
add("v5_player_context", lambda d: V.player_context(d.predictions, PLAYER), f"""
    SELECT player_id, {_MATCHUP}, implied_total, team_spread, team_win_prob,
      CASE WHEN is_dome = 1 THEN 'Dome' WHEN is_bad_weather = 1 THEN 'Bad weather'
           ELSE 'Outdoor' END AS venue, opp_def_ppg_allowed, fantasy_points_3wk_avg,
      prev_season_ppg, CAST(coalesce(team_spread > 0, false) AS INTEGER) AS spread_risk,
      CAST(coalesce(team_win_prob < 0.4, false) AS INTEGER) AS win_prob_risk,
      CAST(coalesce(is_bad_weather = 1, false) AS INTEGER) AS weather_risk
    FROM (SELECT * FROM predictions WHERE player_id = '{PLAYER}'
      ORDER BY season DESC, week DESC LIMIT 1)""",
    "implied_total team_spread team_win_prob opp_def_ppg_allowed fantasy_points_3wk_avg "
    "prev_season_ppg")
add("v6_player_search", lambda d: V.search_players(d.predictions, " pLayer 4"), f"""
    SELECT player_id, player_name, position, recent_team, projected_ppr FROM {_SHOWN}
    WHERE contains(lower(player_name), 'player 4') ORDER BY projected_ppr DESC, player_id
    LIMIT 8""", "projected_ppr")
add("v7_gold_report", lambda d: V.gold_report(d.gold), """
    SELECT 'profile' AS section, 'total_rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM gold
    UNION ALL SELECT 'profile', 'min_week', min(week) FROM gold
    UNION ALL SELECT 'profile', 'max_week', max(week) FROM gold
    UNION ALL SELECT 'profile', 'players', count(DISTINCT player_id) FROM gold
    UNION ALL SELECT 'position', coalesce(position, 'unknown'), count(*) FROM gold GROUP BY position
    UNION ALL (SELECT 'nulls', column_name, nulls FROM (
      SELECT * FROM (SELECT {} FROM gold) UNPIVOT (nulls FOR column_name IN ({})))
      WHERE nulls > 0)
    UNION ALL (SELECT 'best week', coalesce(player_id, 'unknown') || ' ' || season || ' ' || week, fantasy_points_ppr
      FROM gold ORDER BY fantasy_points_ppr DESC, player_id, season, week LIMIT 5)""".format(
        ", ".join(f"count(*) - count({x}) AS {x}" for x in schema.GOLD_COLUMNS),
        _GOLD), "value")
