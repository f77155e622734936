"""Domain-free windows over (entity, season, week) histories.

Partitions are entities after aggregation to one row per week, so a
partition is bounded by the calendar and not by the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions.scoring import ratio


def _season_to_date(entity: Sequence[str], season: str, week: str):
    """Rows strictly before the current one in the same (entity, season)."""
    return (Window.partitionBy(*entity, season).orderBy(week)
            .rowsBetween(Window.unboundedPreceding, -1))


def prior_total(value: Column | str, entity: Sequence[str], season: str = "season",
                week: str = "week") -> Column:
    """Season-to-date total before the current row (0 on the first row)."""
    w = _season_to_date(entity, season, week)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def season_to_date_rate(numerator: Column | str, denominator: Column | str,
                        entity: Sequence[str], season: str = "season",
                        week: str = "week") -> Column:
    """Shifted cumulative ratio; the first row of a season is 0."""
    w = _season_to_date(entity, season, week)
    return ratio(F.sum(numerator).over(w), F.sum(denominator).over(w))


def season_to_date_mean(value: Column | str, entity: Sequence[str],
                        season: str = "season", week: str = "week") -> Column:
    """Shifted cumulative sum over the number of earlier rows."""
    rows_before = F.row_number().over(
        Window.partitionBy(*entity, season).orderBy(week)) - 1
    w = _season_to_date(entity, season, week)
    return ratio(F.sum(value).over(w), rows_before.cast("double"))


def blended_means(df: DataFrame, metrics: Sequence[str], windows: Sequence[int], *,
                  entity: str, season: str = "season", week: str = "week",
                  previous_weight: float = schema.PREVIOUS_SEASON_WEIGHT,
                  name=lambda metric, n: f"{metric}_{n}wk_avg") -> DataFrame:
    """Cross-season blended rolling means of many metrics in one window.

    For each row, the n rows before it are split into those of the current
    season and those of the season before; any older row is ignored. With
    weight 1 for current rows and ``previous_weight`` for previous ones (1 when
    there is no current row yet), the result is the weighted mean, or 0 when
    nothing is left. The row itself is never included, and NULL counts as 0.

    Because rows are in (season, week) order, "the last n - k of the previous
    season" is exactly what lies between lag k + 1 and lag n, so n lags of one
    struct serve all metrics and window lengths.
    """
    order = Window.partitionBy(entity).orderBy(season, week)
    packed = F.expr("struct({} AS _season, {})".format(season, ", ".join(
        f"coalesce(CAST({m} AS DOUBLE), 0D) AS {m}" for m in metrics)))
    steps = range(1, max(windows) + 1)
    df = df.withColumn("_packed", packed)
    df = df.withColumns({f"_lag{i}": F.lag("_packed", i).over(order) for i in steps})
    # lag 1 in the current season means there is at least one current game
    weight = ("CASE WHEN _lag{i}._season = {s} THEN 1D WHEN _lag{i}._season = {s} - 1 "
              "THEN IF(_lag1._season = {s}, {w}D, 1D) ELSE 0D END")
    df = df.withColumns({
        f"_weight{i}": F.expr(weight.format(i=i, s=season, w=previous_weight))
        for i in steps})
    out = {}
    for n in windows:
        weights = " + ".join(f"_weight{i}" for i in range(1, n + 1))
        for m in metrics:
            values = " + ".join(
                f"coalesce(_lag{i}.{m}, 0D) * _weight{i}" for i in range(1, n + 1))
            out[name(m, n)] = F.expr(f"coalesce(try_divide({values}, {weights}), 0D)")
    return df.withColumns(out).drop(
        "_packed", *[f"_lag{i}" for i in steps], *[f"_weight{i}" for i in steps])


def games_before(entity: str, window: int, season: str = "season",
                 week: str = "week") -> Column:
    """Current-season rows among the last ``HISTORY_SPAN * window`` rows."""
    played = F.row_number().over(
        Window.partitionBy(entity, season).orderBy(week)) - 1
    return F.least(played, F.lit(schema.HISTORY_SPAN * window))


def previous_season_summary(value: str, entity: str, season: str = "season"
                            ) -> tuple[Column, Column]:
    """(mean, row count) of the same entity one season earlier; 0 without one.

    A RANGE frame on the season number reaches last season's rows directly, so
    no aggregate has to be shifted and joined back.
    """
    last = Window.partitionBy(entity).orderBy(season).rangeBetween(-1, -1)
    return (F.coalesce(F.avg(value).over(last), F.lit(0.0)),
            F.count(F.lit(1)).over(last).cast("double"))


def days_since_previous(date: str, entity: Sequence[str]) -> Column:
    w = Window.partitionBy(*entity).orderBy(date)
    return F.date_diff(F.col(date), F.lag(date).over(w))


def carry_forward(value: str, entity: Sequence[str], order: str = "week",
                  default=None) -> Column:
    """Last known value up to and including the current row."""
    w = (Window.partitionBy(*entity).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = F.last(value, ignorenulls=True).over(w)
    return filled if default is None else F.coalesce(filled, F.lit(default))


MAX_SEASON, MAX_WEEK = 9999, 60


def season_weeks(calendar: DataFrame, season: str = "season", week: str = "week") -> DataFrame:
    """One row per season with the list of its weeks.

    A season or week outside the calendar's range fails the job, so the result
    is known to hold at most ``MAX_SEASON`` rows of ``MAX_WEEK`` integers (a
    few megabytes) whatever the size of the input.
    """
    inside = F.col(season).between(1, MAX_SEASON) & F.col(week).between(1, MAX_WEEK)
    known = calendar.where(F.col(season).isNotNull() & F.col(week).isNotNull()).select(
        season, week).distinct()
    checked = known.withColumn(week, F.when(inside, F.col(week)).otherwise(F.raise_error(
        F.lit("season or week outside the calendar")).cast("int")))
    return checked.groupBy(season).agg(F.collect_set(week).alias("_weeks"))


def densify(facts: DataFrame, entity: Sequence[str], value: str, *,
            season: str = "season", week: str = "week",
            calendar: DataFrame | None = None) -> DataFrame:
    """Every (entity, season) on every week of that season, value 0 where absent.

    ``calendar`` holds the (season, week) pairs, by default those of
    ``facts``. Folded to one checked row per season it is broadcast: a shuffle
    on the season would put all entities of a season into one task. The facts
    are then added by a union and one grouped sum instead of a join.
    """
    weeks = season_weeks(facts if calendar is None else calendar, season, week)
    entities = facts.select(*entity, season).distinct()
    grid = entities.join(F.broadcast(weeks), season).select(
        *entity, season, F.explode("_weeks").alias(week), F.lit(0.0).alias(value))
    return (grid.unionByName(facts.select(*entity, season, week, value))
            .groupBy(*entity, season, week)
            .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value)))
