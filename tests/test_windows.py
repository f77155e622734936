"""Rolling blends, shifted rates, forward fill and ranking windows."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weekcast.operators import aggregates as A
from weekcast.operators import windows as W


def blended(spark, rows, n):
    df = spark.createDataFrame(rows, "p string, season int, week int, v double")
    out = W.blended_means(df, ["v"], [n], entity="p", name=lambda m, k: "blend")
    out = out.withColumn("games", W.games_before("p", n))
    return {(r.p, r.season, r.week): (r.blend, r.games) for r in out.collect()}


def expected_blend(history, season, n, weight=0.3):
    """Direct reading of the five cases for one row."""
    kept = history[-3 * n:]
    cur = [v for s, v in kept if s == season]
    prev = [v for s, v in kept if s == season - 1]
    if len(cur) >= n:
        return sum(cur[-n:]) / n, len(cur)
    if cur and prev:
        old = prev[-(n - len(cur)):]
        return ((sum(cur) + weight * sum(old)) / (len(cur) + weight * len(old))), len(cur)
    if cur:
        return sum(cur) / len(cur), len(cur)
    if prev:
        return sum(prev[-n:]) / len(prev[-n:]), 0
    return 0.0, 0


@pytest.mark.parametrize("n", [1, 3, 5])
def test_blend_against_direct_model(spark, n):
    rng = random.Random(n)
    rows = []
    for p in range(40):
        for season in (2020, 2021, 2022, 2024):          # 2023 is skipped
            for week in sorted(rng.sample(range(1, 19), rng.randint(0, 18))):
                v = None if rng.random() < 0.1 else round(rng.uniform(-5, 40), 2)
                rows.append((f"p{p}", season, week, v))
    got = blended(spark, rows, n)
    by_player = {}
    for p, season, week, v in sorted(rows, key=lambda r: r[:3]):
        history = by_player.setdefault(p, [])
        want, games = expected_blend(history, season, n)
        value, count = got[(p, season, week)]
        assert value == pytest.approx(want, abs=1e-9)
        assert count == games
        history.append((season, v or 0.0))


def test_blend_cases(spark):
    rows = [("a", 2023, w, float(w)) for w in (1, 2, 3, 4)]
    rows += [("a", 2024, 1, 10.0), ("a", 2024, 2, 20.0), ("a", 2024, 3, 30.0), ("a", 2024, 4, 0.0)]
    rows += [("a", 2026, 1, 5.0)]
    got = blended(spark, rows, 3)
    assert got[("a", 2023, 1)] == (0.0, 0)                                   # nothing before
    assert got[("a", 2023, 2)][0] == 1.0                                     # current only
    assert got[("a", 2024, 1)][0] == pytest.approx(3.0)                      # previous only
    assert got[("a", 2024, 2)][0] == pytest.approx((10 + .3 * 7) / 1.6)      # both
    assert got[("a", 2024, 4)] == (20.0, 3)                                  # current full
    assert got[("a", 2026, 1)] == (0.0, 0)                                   # skipped a season


def test_rates_reset_each_season_and_exclude_the_row(spark):
    df = spark.createDataFrame(
        [("t", 2024, 1, 2.0, 10.0), ("t", 2024, 2, 0.0, 0.0), ("t", 2024, 3, 4.0, 10.0),
         ("t", 2025, 1, 9.0, 9.0), ("t", 2025, 2, 1.0, 2.0)],
        "team string, season int, week int, n double, d double")
    out = df.select("season", "week",
                    W.season_to_date_rate("n", "d", ["team"]).alias("rate"),
                    W.season_to_date_mean("n", ["team"]).alias("mean"),
                    W.prior_total("n", ["team"]).alias("prior"))
    got = {(r.season, r.week): (r.rate, r.mean, r.prior) for r in out.collect()}
    assert got[(2024, 1)] == (0.0, 0.0, 0.0)
    assert got[(2024, 3)] == (0.2, 1.0, 2.0)
    assert got[(2025, 1)] == (0.0, 0.0, 0.0)
    assert got[(2025, 2)] == (1.0, 9.0, 9.0)


def test_previous_season_needs_the_adjacent_season(spark):
    df = spark.createDataFrame(
        [("a", 2022, 1, 4.0), ("a", 2022, 2, 8.0), ("a", 2023, 1, 1.0), ("a", 2025, 1, 1.0)],
        "p string, season int, week int, v double")
    ppg, games = W.previous_season_summary("v", "p")
    got = {(r.season, r.week): (r.ppg, r.games)
           for r in df.select("season", "week", ppg.alias("ppg"), games.alias("games")).collect()}
    assert got[(2022, 2)] == (0.0, 0.0)
    assert got[(2023, 1)] == (6.0, 2.0)
    assert got[(2025, 1)] == (0.0, 0.0)


def test_carry_forward_stops_at_the_season(spark):
    df = spark.createDataFrame(
        [("a", 2024, 1, None), ("a", 2024, 2, 3), ("a", 2024, 3, None), ("a", 2025, 1, None)],
        "p string, season int, week int, rank int")
    out = df.select("season", "week", W.carry_forward(
        "rank", ["p", "season"], default=9).alias("rank"))
    assert {(r.season, r.week): r.rank for r in out.collect()} == {
        (2024, 1): 9, (2024, 2): 3, (2024, 3): 3, (2025, 1): 9}


def test_densified_grid_and_ranking(spark):
    facts = spark.createDataFrame(
        [("a", 2024, 1, 5.0), ("b", 2024, 3, 7.0), ("b", 2025, 2, 1.0)],
        "p string, season int, week int, v double")
    grid = W.densify(facts, ["p"], "v")
    assert sorted(map(tuple, grid.collect())) == [
        ("a", 2024, 1, 5.0), ("a", 2024, 3, 0.0), ("b", 2024, 1, 0.0), ("b", 2024, 3, 7.0),
        ("b", 2025, 2, 1.0)]
    top = A.top_per_group(grid, ["season", "week"], [F.desc("v"), F.asc("p")], 1)
    assert {(r.season, r.week, r.p) for r in top.collect()} == {
        (2024, 1, "a"), (2024, 3, "b"), (2025, 2, "b")}


def test_calendar_outside_its_range_fails(spark):
    facts = spark.createDataFrame([("a", 2024, 61, 1.0)], "p string, season int, week int, v double")
    with pytest.raises(PySparkException):
        W.densify(facts, ["p"], "v").collect()


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame(
        [("x", "WR"), ("x", "RB"), ("y", "QB"), ("y", "WR"), ("y", "WR"), (None, "QB")],
        "p string, pos string")
    assert {tuple(r) for r in A.mode_by_count(df, "p", "pos").collect()} == {
        ("x", "RB"), ("y", "WR")}


def test_top_rows_are_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = A.keep_one(df, ["k"], [F.desc("v")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
