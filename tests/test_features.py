"""Box score and gold table on the small league."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.league import make_sources, play_rows
from weekcast import schema
from weekcast.plans import boxscore as B
from weekcast.plans import features as FT

# Known before kickoff: every column that is neither measured in the game nor
# a list position of the player's whole season.
PRE_GAME = [c for c in schema.GOLD_COLUMNS
            if c not in schema.SAME_WEEK_OUTCOMES + [schema.TARGET, "player_name",
                                                     "position", "recent_team"]]


@pytest.fixture(scope="module")
def gold(spark, league):
    """Players' rows; those without an id have a test of their own."""
    return FT.build_gold(league, keep_unattributed=False).cache()


def rows_of(df, columns):
    def tidy(v):
        return round(v, 8) if isinstance(v, float) else v
    return sorted(tuple(tidy(v) for v in r) for r in df.select(*columns).collect())


def by_key(df, columns):
    return {(r.player_id, r.season, r.week): tuple(r[c] for c in columns)
            for r in df.select(*FT.PLAYER_WEEK, *columns).collect()}


def test_schema_and_key(gold):
    assert [(f.name, f.dataType) for f in gold.schema.fields] == [
        (f.name, f.dataType) for f in schema.GOLD.fields]
    assert len(gold.columns) == 73
    assert gold.groupBy(*FT.PLAYER_WEEK).count().where("count > 1").count() == 0
    assert gold.where(F.col("player_id").isNull()).count() == 0
    filled = gold.select(*[F.count_if(F.col(c).isNull()).alias(c)
                           for c in schema.GOLD_FILL_ZERO]).first()
    assert not any(filled)


def test_facts_agree_with_the_role_box_scores(league):
    facts = B.entity_week_facts(league.plays)
    box = B.box_score(league.plays)
    named = box.where("player_id IS NOT NULL")
    columns = ["player_id", "season", "week", *schema.BOX_COLUMNS, schema.TARGET]
    assert rows_of(B.identified_box(facts, league.rosters), columns) == rows_of(named, columns)
    lost = B.unattributed(box).first()
    assert lost["rows"] > 0


def test_null_ids_of_two_roles_share_one_row(league):
    box = B.box_score(league.plays)
    nobody = box.where("player_id IS NULL").groupBy("season", "week").count()
    assert nobody.where("count > 1").count() == 0
    both = box.where("player_id IS NULL AND pass_attempts > 0 AND rush_attempts > 0")
    assert both.count() > 0


def test_only_starters_at_single_positions(gold):
    assert gold.where("position IN ('QB', 'TE') AND depth_chart_rank <> 1").count() == 0
    assert gold.where("position = 'RB' AND depth_chart_rank > 1").count() > 0


def test_positions_come_from_rosters_or_modal_role(gold):
    position = by_key(gold, ["position"])
    assert {v[0] for k, v in position.items() if k[0] == "AAA-r2"} == {"RB"}      # FB
    assert {v[0] for k, v in position.items() if k[0] == "AAA-w2"} == {"WR"}      # unlisted
    assert {v[0] for k, v in position.items() if k[0] == "CCC-w9"} == {"WR"}


def test_depth_rank_uses_the_latest_snapshot(gold):
    rank = by_key(gold, ["depth_chart_rank", "gameday"])
    early = [v for k, v in rank.items() if k[0] == "AAA-r2" and k[1:] == (2025, 1)]
    later = [v for k, v in rank.items() if k[0] == "AAA-r2" and k[1:] == (2025, 2)]
    assert all(v[0] == 2 for v in early) and all(v[0] == 1 for v in later)


def test_receiver_health(gold):
    health = by_key(gold, ["wr1_wr2_healthy", "recent_team"])
    assert {v[0] for v in health.values()} == {0, 1}
    assert all(v[0] == 1 for k, v in health.items() if v[1] == "AAA")


def test_rows_without_an_id_stay(league, gold):
    everything = FT.build_gold(league).cache()
    nobody = everything.where("player_id IS NULL")
    assert everything.count() == gold.count() + nobody.count()
    lost = B.unattributed(B.box_score(league.plays)).first()
    row = nobody.agg(F.count("*").alias("n"), F.sum(schema.TARGET).alias("p"),
                     F.max("fantasy_points_3wk_avg").alias("form")).first()
    assert (row.n, round(row.p, 2), row.form) == (lost["rows"], round(lost["points"], 2), 0.0)
    assert everything.columns == gold.columns


def test_no_stage_changes_the_result(spark, league, gold):
    direct = FT.build_gold(league, staged=False, keep_unattributed=False)
    assert rows_of(direct, schema.GOLD_COLUMNS) == rows_of(gold, schema.GOLD_COLUMNS)


def test_row_order_and_partitioning_do_not_matter(spark, league, gold):
    shuffled = FT.Sources(*[
        getattr(league, n).orderBy(F.rand(5)).repartition(3) for n in (
            "plays", "schedules", "snap_counts", "injuries", "rosters", "depth_weekly",
            "depth_snapshots")])
    assert rows_of(FT.build_gold(shuffled, keep_unattributed=False), schema.GOLD_COLUMNS) == rows_of(
        gold, schema.GOLD_COLUMNS)


def test_a_week_knows_nothing_of_itself_or_later(spark, gold):
    """Rewriting the measures of week 4 of 2025 and later leaves every
    pre-game column up to and including that week as it was."""
    def change(row):
        for c in ("yards_gained", "air_yards"):
            row[c] = None if row[c] is None else row[c] * 3 + 17
        for c in ("pass_touchdown", "rush_touchdown", "interception", "sack", "complete_pass"):
            row[c] = 1 - row[c]
        return row

    other = FT.build_gold(
        make_sources(spark, play_rows(after=(2025, 4), change=change)), keep_unattributed=False)
    upto = F.struct("season", "week") <= F.struct(F.lit(2025), F.lit(4))
    columns = ["player_id", *PRE_GAME]
    assert rows_of(other.where(upto), columns) == rows_of(gold.where(upto), columns)
    after = ["player_id", "season", "week", "fantasy_points_3wk_avg"]
    assert rows_of(other.where(~upto), after) != rows_of(gold.where(~upto), after)


def test_first_week_of_a_season_has_no_season_to_date(gold):
    first = gold.where("week = 1")
    rates = ["opp_def_sack_rate", "team_sack_rate_allowed", "opp_def_ypc_allowed",
             "opp_def_ypp_allowed", "opp_def_ppg_allowed", "starting_qb_aya"]
    assert first.where(" OR ".join(f"{c} <> 0" for c in rates)).count() == 0
    assert first.where("season > 2023 AND fantasy_points_3wk_avg > 0").count() > 0


def test_side_values_reach_their_rows_in_one_distribution_by_player(spark):
    rows = spark.createDataFrame(
        [("P1", 2020, 1, "A"), ("P1", 2020, 1, "B"), ("P1", 2020, 2, "A"), ("P2", None, 1, "C"),
         ("P3", 2020, 1, None)], "player_id string, season int, week int, player_name string")
    keyed = "player_id string, season int, week int, "
    parts = [
        spark.createDataFrame([("P1", 2020, 1, 0.5), ("P2", None, 1, 0.7), (None, 2020, 1, 0.9),
                               ("P9", 2020, 1, 0.3)], keyed + "snap_share double"),
        spark.createDataFrame([("P1", 2020, 1, 3), ("P3", 2020, 1, 2)], keyed + "rank_weekly int")]
    found = FT.with_player_side(rows, parts)
    want = rows
    for part in parts:
        want = want.join(part, FT.PLAYER_WEEK, "left")
    assert sorted(found.collect(), key=str) == sorted(want.select(*found.columns).collect(), key=str)
    ordered = Window.partitionBy("player_id").orderBy("season", "week")
    plan = found.withColumn("before", F.lag("snap_share").over(ordered))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text
