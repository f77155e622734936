"""Readers. Schemas are declared, never inferred; filters reach the scan."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast import schema

SOURCE_SCHEMAS = {
    "plays": schema.PLAYS,
    "schedules": schema.SCHEDULES,
    "snap_counts": schema.SNAP_COUNTS,
    "injuries": schema.INJURIES,
    "rosters": schema.ROSTERS,
    "depth_weekly": schema.DEPTH_WEEKLY,
    "depth_snapshots": schema.DEPTH_SNAPSHOTS,
}


def read_source(spark: SparkSession, folder: str, name: str,
                seasons: Iterable[int] | None = None, fmt: str = "parquet") -> DataFrame:
    """One source table, optionally limited to some seasons.

    On a table partitioned by season the filter prunes partitions; otherwise
    it is pushed to the parquet row groups.
    """
    df = spark.read.schema(SOURCE_SCHEMAS[name]).format(fmt).load(f"{folder}/{name}")
    if seasons is not None and "season" in df.columns:
        df = df.where(F.col("season").isin(list(seasons)))
    return nan_to_null(df)


def read_depth_charts(spark: SparkSession, folder: str, seasons: Iterable[int] | None = None,
                      last_weekly: int = schema.WEEKLY_DEPTH_LAST_SEASON
                      ) -> tuple[DataFrame, DataFrame]:
    """(weekly lists, snapshots): the two eras have different schemas.

    Snapshots have no season; they are limited by the year of their ISO text, which
    is compared as text and so reaches the scan.
    """
    weekly = read_source(spark, folder, "depth_weekly", seasons)
    snapshots = read_source(spark, folder, "depth_snapshots")
    if seasons is not None:
        years = [(F.col("dt") >= str(y)) & (F.col("dt") < str(y + 1)) for y in seasons]
        snapshots = snapshots.where(reduce(operator.or_, years, F.lit(False)))
    return weekly.where(F.col("season") <= last_weekly), snapshots


def read_gold(spark: SparkSession, path: str, max_week: int | None = None) -> DataFrame:
    df = spark.read.schema(schema.GOLD).parquet(path)
    return df if max_week is None else fantasy_weeks(df, max_week)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions history; slices written before a column existed read NULL."""
    return spark.read.schema(schema.PREDICTIONS).parquet(path)


def fantasy_weeks(df: DataFrame, max_week: int = schema.FANTASY_MAX_WEEK) -> DataFrame:
    return df.where(F.col("week") <= max_week)


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = (T.FloatType, T.DoubleType)
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, floating)} or {})
