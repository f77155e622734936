"""Sinks: full rebuild, slice replace, schema conformance, quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.session import shuffles_removed, stage

SLICE = ["season", "week"]


def rebuild(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a whole table, schema included, partitioned by slice.

    The rebalance hint gathers each slice into few files and lets adaptive
    execution split a slice that holds far more rows than the others.
    """
    writer = df.hint("rebalance", *SLICE).write.mode("overwrite").partitionBy(*SLICE)
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    with shuffles_removed(df.sparkSession):
        writer.format(fmt).save(path)


def inside_slice(df: DataFrame, season: int, week: int) -> DataFrame:
    """``df``; a row of another slice, or of none, raises when it is read."""
    inside = (F.col("season") == season) & (F.col("week") == week)
    return df.withColumn("season", F.when(
        F.coalesce(inside, F.lit(False)), F.col("season")).otherwise(F.raise_error(
            F.concat(F.lit(f"row outside slice {season}/{week}: "),
                     F.coalesce(F.concat_ws("/", "season", "week"), F.lit("NULL")))).cast("int")))


def replace_slice(df: DataFrame, path: str, season: int, week: int,
                  fmt: str = "parquet") -> None:
    """Replace one (season, week) slice and keep all other history.

    Every row must belong to the slice; a stray row fails the write before any
    file of the table is replaced. An empty frame empties the slice.
    """
    checked = inside_slice(df, season, week)
    if fmt == "delta":
        checked.hint("rebalance").write.mode("overwrite").format(fmt).option(
            "replaceWhere", f"season = {season} AND week = {week}").option(
            "mergeSchema", "true").save(path)
        return
    rows = stage(checked, "slice")
    if rows.isEmpty():
        # a dynamic overwrite would keep the old rows: overwrite the slice's own folder
        rows.drop(*SLICE).write.mode("overwrite").format(fmt).save(
            f"{path}/season={season}/week={week}")
    else:
        with shuffles_removed(df.sparkSession):
            rows.hint("rebalance").write.mode("overwrite").format(fmt).option(
                "partitionOverwriteMode", "dynamic").partitionBy(*SLICE).save(path)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exactly the target's columns and types: cast, drop extras, NULL absentees."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.fields])


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns only one side has are NULL on the other."""
    return old.unionByName(new, allowMissingColumns=True)


def slice_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("row_count"))


class MissingSliceError(RuntimeError):
    """A table that a job depends on lacks a required slice."""


def require_slice(df: DataFrame, season: int, week: int) -> int:
    """Row count of a slice; raises when the season or the week is absent."""
    counts = {r["week"]: r["row_count"] for r in slice_counts(
        df.where(F.col("season") == season)).collect()}
    if not counts:
        raise MissingSliceError(f"no rows of season {season}")
    if week not in counts:
        raise MissingSliceError(f"season {season} has no rows of week {week}")
    return counts[week]


def merged_history(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose slices were written with different column sets."""
    return spark.read.option("mergeSchema", "true").parquet(path)
