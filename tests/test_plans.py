"""Physical plan shapes that the scaling notes rely on."""

from weekcast.operators import joins as J
from weekcast.plans import boxscore as B
from weekcast.sources.sinks import rebuild
from weekcast.session import new_path
from weekcast.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_plays(spark, league):
    folder = new_path(spark, "plans")
    rebuild(league.plays, f"{folder}/plays")
    return tables.read_source(spark, folder, "plays")


def test_facts_are_one_scan_one_hash_aggregation_one_shuffle(spark, league):
    text = plan(B.entity_week_facts(stored_plays(spark, league)))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1
    assert "SortAggregate" not in text


def test_box_score_of_all_roles_is_one_shuffle(spark, league):
    text = plan(B.box_score(stored_plays(spark, league)))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1
    assert "SortAggregate" not in text


def test_identity_windows_share_one_distribution(spark, league):
    facts = spark.createDataFrame([], B.entity_week_facts(league.plays).schema)
    rosters = spark.createDataFrame([], league.rosters.schema)
    text = plan(B.identified_box(facts, rosters))
    after_join = text.split("Join")[0]
    assert "Window" in after_join and "Exchange" not in after_join
    assert after_join.count("Sort [") <= 1


def test_no_cross_join_in_the_asof_search(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-01")], "id int, k string, t string")
    right = spark.createDataFrame([("a", "2024-01-01", 1)], "k string, at string, v int")
    text = plan(J.asof_backward(left, right, "k", "t", "at", "v"))
    assert "Cartesian" not in text and "NestedLoop" not in text
