"""The weekly run: from gold and the predictions history to the week's told slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.operators import aggregates as A
from weekcast.plans import evaluation as E
from weekcast.plans import insight
from weekcast.plans.serving import in_latest_slice
from weekcast.session import stage
from weekcast.sources.sinks import conform, replace_slice
from weekcast.sources.tables import read_predictions


def weekly_run(gold: DataFrame, predictions_path: str,
               generate: Callable[[str], str] | None = None, told: int | None = None,
               params: E.Params = E.Params()) -> DataFrame:
    """Write the week's projections with text and return them, best first.

    A forward slate that is already in the history is kept; otherwise the newest week
    of gold is projected by a model trained on everything before it and written. Then
    the ``told`` best rows (all by default) get text, and the slice is written again.
    """
    spark = gold.sparkSession
    history = read_predictions(spark, predictions_path)
    forward = E.is_forward_slate(gold, history)
    if forward:
        week = stage(in_latest_slice(history), "week")       # its slice is overwritten below
    else:
        week = stage(conform(E.predict_latest(gold, params), schema.PREDICTIONS), "week")
    season, number = week.select("season", "week").first()
    if not forward:
        replace_slice(week, predictions_path, season, number)
    ranked = A.ranked(insight.without_insights(week), ["season", "week"],
                      [F.desc_nulls_last("projected_ppr"), F.asc("player_id")], "_place")
    best = F.lit(True) if told is None else F.col("_place") <= told
    with_text = insight.with_generated(ranked.where(best).drop("_place"), generate)
    silent = ranked.where(~best).drop("_place")
    replace_slice(conform(with_text.unionByName(silent, allowMissingColumns=True),
                          schema.PREDICTIONS), predictions_path, season, number)
    return read_predictions(spark, predictions_path).where(
        (F.col("season") == season) & (F.col("week") == number)).orderBy(
        F.desc_nulls_last("projected_ppr"), F.asc("player_id"))
