"""Domain-free aggregations. Every one combines on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.scoring import absolute_error, total


def sums(df: DataFrame, keys: Sequence[str], **columns: Column | str) -> DataFrame:
    """Group sums with NULL read as 0. NULL keys form a group of their own."""
    return df.groupBy(*keys).agg(*[total(c).alias(n) for n, c in columns.items()])


def mode_by_count(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; a tie goes to the smallest value.

    Counts first, so only one row per distinct (key, value) is shuffled, and
    the pick is a plain maximum rather than a per-key histogram buffer.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return (counted.withColumn("_rank", F.row_number().over(best))
            .where("_rank = 1").select(key, value))


def _candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows by a hash aggregation that stays in the plan.

    A struct minimum or maximum has a variable-width buffer, so Spark sorts
    its input; it should only ever see distinct candidates. A bare
    ``distinct`` below such a function is optimised away, a filtered count is
    not.
    """
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
            .where("_n > 0").select(*columns))


def first_by(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First non-null value per key in the given order."""
    pick = F.min(F.struct(*order, value))
    known = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    return (_candidates(known, [key, *order, value]).groupBy(key).agg(pick.alias("_pick"))
            .select(key, F.col(f"_pick.{value}").alias(value)))


def last_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last non-null value per key in the given order; ties to the largest value."""
    pick = F.max(F.struct(*order, value))
    known = df.where(F.col(value).isNotNull())
    return (_candidates(known, [*keys, *order, value])
            .groupBy(*keys).agg(pick.alias("_pick"))
            .select(*keys, F.col(f"_pick.{value}").alias(value)))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order.

    Filtering ``row_number() = 1`` lets Spark keep a single row per key on the
    map side before shuffling, so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(w))
            .where("_rank = 1").drop("_rank"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
           rank: str = "rank") -> DataFrame:
    """Every row with its 1-based rank within its key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first k rows per key with their 1-based rank (pruned on the map side)."""
    return ranked(df, keys, order, rank).where(F.col(rank) <= k)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for the columns that have any NULL."""
    names = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in names])
    return counts.select(F.inline(pairs)).where("nulls > 0")


def profile(df: DataFrame, entity: str, season: str = "season", week: str = "week") -> DataFrame:
    """One row: size, seasons, week range and distinct entities.

    Spark plans the distinct count as a grouped de-duplication followed by a
    count, so no task holds the set of entities.
    """
    seasons = F.array_sort(F.collect_set(season))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.array_join(F.transform(seasons, lambda s: s.cast("string")), ",").alias("seasons"),
        F.min(week).alias("min_week"), F.max(week).alias("max_week"),
        F.count_distinct(entity).alias("players"))


def mean_absolute_error(df: DataFrame, actual: str, predicted: str,
                        *keys: str) -> DataFrame:
    """MAE and row count, overall or per key."""
    error = absolute_error(actual, predicted)
    return df.groupBy(*keys).agg(
        F.avg(error).alias("mae"), F.count(F.lit(1)).alias("n"))


def latest_slice(df: DataFrame) -> DataFrame:
    """One row: the greatest (season, week)."""
    return (df.agg(F.max(F.struct("season", "week")).alias("latest"))
            .select("latest.season", "latest.week"))
