"""The weekly run on small source tables, both ways."""

from pyspark.sql import functions as F

from weekcast.plans.evaluation import Params
from weekcast.plans.features import build_gold
from weekcast.plans.weekly import weekly_run
from weekcast.session import new_path
from weekcast.sources.sinks import conform, rebuild
from weekcast.sources.tables import read_predictions
from weekcast import schema


def test_trains_when_gold_is_ahead_and_keeps_a_forward_slate(spark, league):
    gold = build_gold(league).cache()
    last = gold.agg(F.max(F.struct("season", "week"))).first()[0]
    path = new_path(spark, "weekly")
    old = gold.where((F.col("season") != last["season"]) | (F.col("week") != last["week"]))
    rebuild(conform(old.withColumn("projected_ppr", F.lit(1.0)), schema.PREDICTIONS), path)
    before = read_predictions(spark, path).count()
    rows = weekly_run(gold, path, generate=lambda text: "told", told=3,
                      params=Params(rounds=2, patience=1)).collect()
    assert {(r.season, r.week) for r in rows} == {(last["season"], last["week"])}
    scores = [r.projected_ppr for r in rows]
    assert scores == sorted(scores, reverse=True) and min(scores) >= 0
    assert [r.insight for r in rows] == ["told"] * 3 + [None] * (len(rows) - 3)
    assert read_predictions(spark, path).count() == before + len(rows)
    # now the history is ahead of an older gold: nothing is trained, text is renewed
    again = weekly_run(old, path).collect()
    assert [r.projected_ppr for r in again] == scores
    assert all(r.insight_source == "offline_template" for r in again)
    assert read_predictions(spark, path).count() == before + len(rows)


def test_both_branches_are_registered_whole(spark, monkeypatch):
    """No cut of the told rows and the default training settings."""
    import __spark_entry__ as entry
    from checks import suite_sources as P
    seen = []
    whole = P.weekly_run

    def kept(*args, **named):
        seen.append(named)
        return whole(*args, **named)

    monkeypatch.setattr(P, "weekly_run", kept)
    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["i5_weekly_run_all"](spark, folder).collect()
    assert rows and all(r.insight for r in rows) and seen == [{}]
    monkeypatch.setattr(P, "weekly_run", lambda gold, path, **named:
                        seen.append(named) or read_predictions(spark, path))
    history = entry.queries()["i5_weekly_run_trained"](spark, folder)
    assert seen[-1] == {}                       # all rows told, default settings
    newest = lambda df: df.agg(F.max(F.struct("season", "week"))).first()[0]
    assert newest(history) < newest(entry.queries()["q4_latest_predictions"](spark, folder))
