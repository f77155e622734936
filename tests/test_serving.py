"""Serving queries and dashboard views on hand-written rows."""

import decimal

import pytest

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.plans import serving as Q
from weekcast.plans import views as V
from weekcast.sources.sinks import conform


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        ("a", "Alpha", "QB", "KC", "BUF", 2025, 2, 22.0, None, 1.0, "good"),
        ("b", "Beta", "RB", "KC", "BUF", 2025, 2, 14.0, 20.5, 0.0, " "),
        ("c", "Gamma", "WR", "BUF", "KC", 2025, 2, 18.0, 11.0, 1.0, None),
        ("d", "Delta", "K", "BUF", "KC", 2025, 2, None, 3.0, None, "some"),
        ("e", "Echo", "TE", "BUF", "KC", 2025, 1, 9.0, 8.0, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "player_id string, player_name string, position string, "
                               "recent_team string, opponent string, season int, week int, "
                               "projected_ppr double, actual_ppr double, is_home double, "
                               "insight string")
    return conform(df, schema.PREDICTIONS).cache()


@pytest.fixture(scope="module")
def gold(spark):
    rows = [("a", "Alpha", "QB", "KC", 2024, 5, 10.0, 1), ("a", "Alpha", "QB", "BUF", 2025, 1, 20.0, 1),
            ("b", "Beta", "RB", "KC", 2025, 1, 12.0, 2), ("f", "Fox", "RB", "KC", 2023, 9, 1.0, None)]
    df = spark.createDataFrame(rows, "player_id string, player_name string, position string, "
                               "recent_team string, season int, week int, "
                               "fantasy_points_ppr double, depth_chart_rank int")
    return conform(df, schema.GOLD).cache()


def ids(df):
    return [r.player_id for r in df.collect()]


@pytest.mark.parametrize("given, want", [((50, 0), (50, 0)), ((9999, -3), (700, 0)), ((0, 10), (1, 10))])
def test_clamp(given, want):
    assert Q.clamp_page(*given) == want


@pytest.mark.parametrize("given, want", [(" qb ", "QB"), ("  ", None), (None, None), ("kc", "KC")])
def test_normalise(given, want):
    assert Q.normalise_code(given) == want


def test_filters(predictions):
    latest = Q.in_latest_slice(predictions)
    assert set(ids(Q.matching(latest, team="kc"))) == {"a", "b"}
    assert set(ids(Q.matching(latest, min_projected=18))) == {"a", "c"}
    assert set(ids(Q.matching(latest, position=" ", team=""))) == {"a", "b", "c", "d"}


def test_latest_predictions_has_all_fields_in_order(predictions):
    out = Q.latest_predictions(predictions)
    assert len(out.columns) == 23
    assert ids(out) == ["a", "c", "b", "d"]


def test_pages_carry_the_true_total(predictions):
    rows = Q.list_predictions(predictions, limit=2, offset=1).collect()
    assert [r.player_id for r in rows] == ["c", "b"] and {r.total for r in rows} == {4}
    assert Q.list_predictions(predictions, offset=50).count() == 0


def test_top_and_single(predictions):
    assert ids(Q.top_predictions(predictions, 1)) == ["a"]
    with pytest.raises(ValueError):
        Q.top_predictions(predictions, 0)
    assert Q.get_prediction(predictions, "e").first().week == 1
    assert Q.get_prediction(predictions, "nobody").count() == 0


def test_players_filter_after_ranking(gold):
    listed = Q.list_players(gold, team="KC").collect()
    assert [(r.player_id, r.total) for r in listed] == [("b", 2), ("f", 2)]
    assert len(listed[0]) == 9
    assert set(ids(Q.latest_on_team(gold, "kc"))) == {"a", "b", "f"}


def test_player_detail(gold):
    row = Q.get_player(gold, "a").first()
    assert (row.recent_team, row.games_played, row.first_season, row.career_ppg, row.career_high) == (
        "BUF", 2, 2024, 15.0, 20.0)
    assert Q.get_player(gold, "nobody").count() == 0
    assert [r.season for r in Q.player_history(gold, "a").collect()] == [2025, 2024]
    assert Q.player_history(gold, "a", season=2024).first().total == 1


def test_roster_joins_only_the_latest_slate(gold, predictions):
    rows = Q.team_roster(gold, predictions, "KC").collect()
    assert [(r.player_id, r.projected_ppr, r.week) for r in rows] == [
        ("a", 22.0, 2), ("b", 14.0, 2), ("f", None, 9)]


def test_empty_predictions_leave_the_roster(spark, gold, predictions):
    rows = Q.team_roster(gold, predictions.limit(0), "KC").collect()
    assert {(r.player_id, r.projected_ppr) for r in rows} == {("a", None), ("b", None), ("f", None)}


def test_rankings_put_missing_values_last_both_ways(predictions):
    assert ids(V.rankings(predictions, "actual_ppr", True))[-1] == "a"
    assert ids(V.rankings(predictions, "actual_ppr", False)) == ["d", "c", "b", "a"]
    assert ids(V.rankings(predictions, position="WR")) == ["c", "d"]       # K is shown as WR
    with pytest.raises(ValueError):
        V.rankings(predictions, "player_name")


def test_slate_summary_and_insights(predictions):
    row = V.slate_summary(predictions).first()
    assert (row.players, row.games, row.insights, row.top_projection) == (4, 1, 2, 22.0)
    told = {r.player_id: r.featured for r in V.slate_insights(predictions).collect()}
    assert told == {"a": 1, "d": 0}


def test_results_and_search(predictions):
    rows = V.results(predictions).collect()
    assert [(r.player_id, r.delta, r.matchup) for r in rows] == [
        ("b", 6.5, "@ BUF"), ("c", -7.0, "vs KC"), ("d", 3.0, "@ KC")]
    assert ids(V.search_players(predictions, " LPH ")) == ["a"]
    assert ids(V.search_players(predictions, "  ")) == []


def test_team_depth_order(gold, predictions):
    rows = V.team_depth(gold, predictions, "KC").collect()
    assert [(r.player_id, r.on_roster) for r in rows] == [("a", 1), ("b", 2), ("f", 2)]


def test_serving_conversion(spark):
    rows = [(decimal.Decimal("2025"), decimal.Decimal("3"), decimal.Decimal("14.2"), float("nan"))]
    df = spark.createDataFrame(rows, "season decimal(10,0), depth_chart_rank decimal(5,0), "
                               "projected_ppr decimal(8,2), temp double")
    row = df.select(*S.serving_columns(df)).first()
    assert row == (2025, 3, 14.2, None)
    assert isinstance(row.season, int) and isinstance(row.projected_ppr, float)


def test_results_pass_over_an_unplayed_slice(spark, predictions):
    """The newest slice has no scores yet: the one before it is shown."""
    rows = [("a", "Alpha", "QB", "KC", "BUF", 2025, 3, 22.0, None)]
    ahead = conform(spark.createDataFrame(
        rows, "player_id string, player_name string, position string, recent_team string, "
        "opponent string, season int, week int, projected_ppr double, actual_ppr double"),
        schema.PREDICTIONS)
    shown = V.results(predictions.unionByName(ahead)).collect()
    assert shown == V.results(predictions).collect() and {r.week for r in shown} == {2}
