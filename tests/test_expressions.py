"""Scoring, odds, rounding, text and evaluation helpers."""

import pytest
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.plans import evaluation as E
from weekcast.plans import insight as I
from weekcast.plans.context import game_context, slate_context
from weekcast.sources.sinks import conform


@pytest.mark.parametrize("line, gold, slate", [
    (-150.0, 0.6, 0.6), (130.0, 100 / 230, 100 / 230), (0.0, 1.0, 0.0), (None, 0.5, 0.5),
    (-100.0, 0.5, 0.5)])
def test_moneyline(spark, line, gold, slate):
    row = spark.createDataFrame([(line,)], "line double").select(
        S.moneyline_probability("line"),
        S.moneyline_probability("line", zero_is_underdog=False)).first()
    assert row == pytest.approx((gold, slate))


def test_rounding_and_division(spark):
    row = spark.createDataFrame([(12.25, 0.0, None)], "x double, z double, n double").select(
        S.round_even("x", 1), S.round_half_up("x", 1), S.ratio("x", "z"), S.ratio("n", "x"),
        S.ratio("z", "z"), S.at_least_zero(-F.col("x")), S.at_least_zero("n")).first()
    assert tuple(row) == (12.2, 12.3, 0.0, 0.0, 0.0, 0.0, None)


def test_context_of_the_league(league):
    rows = {(r.season, r.week, r.team): r for r in game_context(league.schedules).collect()}
    home, away = rows[(2024, 1, "AAA")], rows[(2024, 1, "BBB")]
    assert home.team_spread == -away.team_spread and home.opponent == "BBB"
    assert home.implied_total + away.implied_total == 45.0
    assert all(r.rest_advantage == 0 for k, r in rows.items() if k[1] == 1)
    assert rows[(2024, 2, "DDD")].team_win_prob == 0.5                     # no line
    assert all(r.is_bad_weather == 0 for r in rows.values() if r.is_dome or r.week == 6)
    assert any(r.is_bad_weather for r in rows.values())


def test_future_context_defaults(league):
    rows = {r.team: r for r in slate_context(league.schedules, 2025, 4).collect()}
    assert all(r.implied_total == 22.0 + r.team_spread / 2 for r in rows.values())   # no total
    week2 = {r.team: r for r in slate_context(league.schedules, 2025, 2).collect()}
    lost = [r for r in week2.values() if r.missing_vegas_lines]
    assert lost and all(r.team_spread == 0 and r.team_win_prob == 0.5 for r in lost)
    assert {r.temp for r in week2.values()} == {72.0}
    # two teams had no game in week 3, so week 4 rest is unknown for one side
    assert all(r.rest_advantage == 0 for r in rows.values()
               if r.team in ("CCC", "DDD"))


def prediction(spark, **values):
    base = dict(player_id="p", player_name="Al Pha", position="RB", recent_team="KC",
                opponent="BUF", season=2025, week=2, projected_ppr=14.2, implied_total=24.25,
                team_spread=3.0, team_win_prob=0.6, is_home=1.0, temp=50.0, wind=7.0,
                is_bad_weather=0.0, is_dome=0.0, fantasy_points_3wk_avg=12.35,
                depth_chart_rank=1, opp_def_ppg_allowed=20.0, prev_season_ppg=9.0)
    base.update(values)
    names = [f.name for f in schema.PREDICTIONS.fields]
    return spark.createDataFrame([tuple(base.get(n) for n in names)], schema.PREDICTIONS)


@pytest.mark.parametrize("change, ending", [
    ({}, "over the last three weeks."),
    ({"is_bad_weather": 1.0, "opp_def_ppg_allowed": 5.0}, "Bad weather is a downside risk for this game."),
    ({"opp_def_ppg_allowed": 9.95}, "stingy against RBs (" + f"{9.95:.1f}" + " PPR pts/game allowed)."),
    ({"prev_season_ppg": 0.0}, "Risk: no prior-season scoring history (rookie or unranked)."),
    ({"fantasy_points_3wk_avg": None}, "with no in-season form yet (week 1)."),
])
def test_template_branches(spark, change, ending):
    text = I.with_templates(prediction(spark, **change)).first().insight
    assert text.startswith("Al Pha projects for 14.2 PPR points against BUF. Vegas implies a "
                           f"{24.25:.1f}-point team total in a favorable game script, ")
    assert text.endswith(ending)
    if not change:
        assert f"averaged {12.35:.1f} points" in text


def test_prompt_lines(spark):
    text = I.with_prompts(prediction(spark, fantasy_points_3wk_avg=0.0, team_spread=-2.5,
                                     is_home=0.0, is_bad_weather=1.0)).first().prompt
    lines = text.split("\n")
    assert lines[4] == "" and lines[5] == "Player: Al Pha (RB, KC)"
    assert lines[6] == "Opponent: BUF (on the road)"
    assert "not available yet (no games played this season)" in lines[8]
    assert lines[10] == ("Vegas implied team total: 24.25 | spread: -2.5 | win prob: 60%")
    assert lines[-1] == "Weather: 50F, 7 mph wind — bad weather game"


def test_generator_falls_back_per_row(spark):
    rows = prediction(spark).unionByName(prediction(spark, player_id="q", player_name="Bad"))

    def generate(request):
        if "Bad" in request:
            raise RuntimeError("down")
        return "generated"

    got = {r.player_id: (r.insight_source, r.insight)
           for r in I.with_generated(rows, generate, "model-x").collect()}
    assert got["p"] == ("model-x", "generated")
    assert got["q"][0] == I.TEMPLATE_SOURCE and got["q"][1].startswith("Bad projects")


def test_feature_groups():
    assert len(schema.SHARED_FEATURES) == 18
    assert {p: len(f) for p, f in schema.POSITION_FEATURES.items()} == {
        "QB": 7, "RB": 7, "WR": 9, "TE": 8}
    assert not set(E.feature_names()) & set(
        schema.SAME_WEEK_OUTCOMES + schema.IDENTIFIER_COLUMNS + [schema.TARGET])
    assert len(schema.SAME_WEEK_OUTCOMES) == 25 and len(E.GRID) == 12


def test_splits(spark):
    df = spark.createDataFrame(
        [(s, w) for s in (2023, 2024, 2025) for w in range(1, 6)], "season int, week int")
    split = lambda c: {(r.season, r.week): r.split
                       for r in df.select("season", "week", c.alias("split")).collect()}
    fold = split(E.walk_forward_split(2025, 4))
    assert fold[(2024, 5)] == "train" and fold[(2025, 2)] == "train"
    assert fold[(2025, 3)] == "val" and fold[(2025, 4)] == "test" and fold[(2025, 5)] is None
    cold = split(E.cold_start_split(2025))
    assert cold[(2024, 1)] == "val" and cold[(2025, 1)] == "test" and cold[(2025, 2)] is None
    assert split(E.slate_split(2025))[(2024, 1)] == "val"
    assert split(E.static_split(2025, 2))[(2025, 3)] == "test"


def test_walk_forward_and_comparison(spark, league):
    from dataclasses import replace

    from weekcast.plans.features import build_gold
    frame = E.training_frame(build_gold(league)).cache()
    params = replace(E.Params(), rounds=3, patience=1, max_depth=2)
    results = E.walk_forward(frame, params, weeks=(4, 5)).cache()
    assert {r.test_week for r in results.select("test_week").distinct().collect()} == {4, 5}
    tests = frame.where("season = 2025 AND week IN (4, 5)")
    assert results.count() == tests.count()
    table = {r.position: r for r in E.compare(
        {"naive": E.naive_form(tests), "model": results}).collect()}
    assert set(table) == {"QB", "RB", "WR", "TE", "OVERALL"}
    assert 0 < table["OVERALL"].model < 100
    assert E.mean_best_iteration(results).first()[0] >= 0
    again = E.walk_forward(frame, params, weeks=(4, 5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, results.collect()))
    with pytest.raises(ValueError):
        E.walk_forward(frame, params, weeks=(15, 16))


def test_slate_rows_and_output(spark, league):
    from weekcast.plans import slate as SL
    from weekcast.plans.features import build_gold
    gold = build_gold(league).cache()
    build = lambda cold: {r.player_id: r for r in SL.build_slate(
        SL.before(gold, 2025, 2), league.schedules, league.rosters, league.depth_snapshots,
        2025, 2, cold).collect()}
    blend, zero = build("blend"), build("zero")
    assert set(blend) == set(zero)
    assert "AAA-q2" not in blend and "AAA-r1" in blend                     # starters only
    for player, row in zero.items():
        if row.rolling_games_count == 0:
            assert row.fantasy_points_3wk_avg == 0
        else:
            assert row.fantasy_points_3wk_avg == blend[player].fantasy_points_3wk_avg
    # the slate's form is what gold holds for the same week once it is played
    played = {r.player_id: r for r in gold.where("season = 2025 AND week = 2").collect()}
    common = [p for p in played if p in blend and not p.endswith(("q1", "t1"))]
    assert common and all(
        blend[p].fantasy_points_5wk_avg == pytest.approx(played[p].fantasy_points_5wk_avg)
        for p in common)
    with pytest.raises(ValueError):
        build("other")
    opening = SL.build_opening_slate(gold, league.schedules, league.rosters,
                                     league.depth_snapshots, 2025)
    assert opening.where("fantasy_points_3wk_avg <> 0 OR week <> 1").count() == 0
    scored = opening.withColumn("prediction", F.lit(-1.0))
    out = SL.to_predictions(SL.slate_output(scored))
    assert out.schema == conform(out, schema.PREDICTIONS).schema
    assert out.select("projected_ppr").distinct().collect() == [(0.0,)]


def test_batches_are_asked_again_then_prompt_by_prompt(spark, tmp_path):
    """A batch that fails once is asked again; a bad prompt costs its own row only."""
    rows = conform(spark.createDataFrame(
        [(f"p{i}", "N", "QB", 2025, 3, float(i)) for i in range(10)],
        "player_id string, player_name string, position string, season int, week int, "
        "projected_ppr double"), schema.PREDICTIONS).coalesce(1)
    log = str(tmp_path / "asked")

    def generate(prompts):
        with open(log, "a") as f:
            f.write(f"{len(prompts)}\n")
        if any("7.0" in p for p in prompts):
            raise RuntimeError("refused")
        return [] if len(prompts) == 2 else [f"told {p.count('PPR')}" for p in prompts]

    out = I.with_generated_batches(rows, generate, "model-x", batch=4, in_flight=1)
    found = {r.player_id: r for r in out.collect()}
    assert out.count() == 10 and len(found) == 10
    asked = open(log).read().split()
    assert asked == ["4", "4", "4", "1", "1", "1", "1", "1", "2", "2", "1", "1"]
    assert {p for p, r in found.items() if r.insight_source == "offline_template"} == {"p7"}
    assert found["p7"].insight and found["p1"].insight.startswith("told")
