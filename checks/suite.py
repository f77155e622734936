"""Registry of runnable queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.tables_sql import with_tables
from weekcast import schema
from weekcast.functions import labels as L
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A
from weekcast.plans.features import Sources, build_gold
from weekcast.session import new_path
from weekcast.sources import catalog, sinks, tables
from weekcast.sources.binding import StarTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 9


@dataclass(frozen=True)
class Domain:
    """Domain tables of one data folder; gold and predictions are written once
    per session and read back like any stored table."""

    spark: SparkSession
    folder: str

    @cached_property
    def star(self) -> StarTables:
        return StarTables(self.spark, self.folder)

    @cached_property
    def plays(self) -> DataFrame:
        return self.star.plays()

    @cached_property
    def box_plays(self) -> DataFrame:
        """Plays without the columns that need other tables: teams and yard line."""
        apart = {"posteam", "defteam", "yardline_100"}
        return self.star.plays([f.name for f in schema.PLAYS.fields if f.name not in apart])

    @cached_property
    def sources(self) -> Sources:
        s = self.star
        return Sources(self.plays, s.schedules, s.snap_counts, s.injuries, s.rosters,
                       s.depth_weekly, s.depth_snapshots)

    def source_folder(self, *names: str) -> str:
        """The folder of the source tables as stored parquet; of these the named ones are
        there, each written when it is first asked for."""
        folder = self.once("sources", lambda: new_path(self.spark, "sources"))
        for name in names:
            self.once(f"source {name}", lambda: self._store_source(name, f"{folder}/{name}"))
        return folder

    def _store_source(self, name: str, path: str) -> None:
        df = getattr(self.sources, name)
        writer = sinks.rebuild if {"season", "week"} <= set(df.columns) else _write
        writer(df, path)

    @cached_property
    def gold_path(self) -> str:
        path = new_path(self.spark, "gold")
        sinks.rebuild(build_gold(self.sources), path)
        return path

    @property
    def gold(self) -> DataFrame:
        return tables.read_gold(self.spark, self.gold_path)

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """What ``make`` gives, made once: fitted models are shared by the queries that show
        and verify them."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @cached_property
    def made(self) -> dict[str, Any]:
        return {}

    @cached_property
    def unfiltered_gold(self) -> DataFrame:
        """Gold of known players before the starter filter, stored."""
        path = new_path(self.spark, "gold-all")
        sinks.rebuild(build_gold(self.sources, starters=False, keep_unattributed=False), path)
        return self.spark.read.schema(schema.GOLD).parquet(path)

    @cached_property
    def predictions_path(self) -> str:
        path = new_path(self.spark, "predictions")
        sinks.rebuild(predictions_of(self.gold), path)
        return path

    @property
    def predictions(self) -> DataFrame:
        return tables.read_predictions(self.spark, self.predictions_path)


    def table(self, name: str) -> DataFrame:
        """Gold or predictions as a table of the session catalog."""
        return self.spark.table(self.table_name(name))

    def table_name(self, name: str) -> str:
        def make():
            path, target = {"gold": (self.gold_path, schema.GOLD),
                            "predictions": (self.predictions_path, schema.PREDICTIONS)}[name]
            return registered(self.spark, path, target)
        return self.once(f"table {name}", make)

    def newest(self, name: str) -> tuple[int, int]:
        return catalog.newest_slice(self.spark, self.table_name(name))


def registered(spark: SparkSession, path: str, target: T.StructType) -> str:
    name = "weekcast_" + path.rsplit("-", 1)[1]
    catalog.register(spark, name, path, target)
    return name


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def predictions_of(gold: DataFrame) -> DataFrame:
    """A predictions history over every slice of gold, the newest one unplayed."""
    four = lambda c: F.round(F.col(c).cast("decimal(28,9)"), 4).cast("double")
    newest = gold.select("season", "week").orderBy(F.desc("season"), F.desc("week")).first()
    unplayed = ((F.col("season") == F.lit(newest["season"]))
                & (F.col("week") == F.lit(newest["week"]))) if newest else F.lit(False)
    rows = gold
    context = [F.col(c) if c == "depth_chart_rank"
               else four(c).alias(c)
               for c in schema.PREDICTION_CONTEXT]
    hidden = (F.col("position") == "QB") & (F.col("is_dome") == 1)
    rows = rows.select(
        "player_id", "player_name", "position", "recent_team", "opponent", "season", "week",
        F.when(~F.coalesce(hidden, F.lit(False)),
               S.round_even(four("fantasy_points_5wk_avg"), 1)).alias("projected_ppr"),
        F.when(~unplayed, S.round_even(schema.TARGET, 1)).alias("actual_ppr"), *context)
    text = F.when(F.col("position") == "TE", "").when(
        F.coalesce(F.col("depth_chart_rank") == 2, F.lit(False)), None).otherwise(
        L.template_insight())
    return rows.withColumns({"insight": text, "insight_source": F.lit("offline_template")})


_domains: dict[tuple[str, str], Domain] = {}


def domain(spark: SparkSession, folder: str) -> Domain:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _domains:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _domains[key] = Domain(spark, folder.rstrip("/"))
    return _domains[key]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to a fixed precision and without negative zero, so that results
    do not depend on the order of summation."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def add(name: str, run: Callable[[Domain], DataFrame], sql: str | None = None,
        doubles: str = "") -> None:
    """Register a query; ``doubles`` names the columns the SQL side rounds."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: tidy(run(domain(spark, folder)))
    if sql is not None:
        rounded = ", ".join(
            f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
        replace = f" REPLACE ({rounded})" if rounded else ""
        ORACLE[name] = with_tables(f"SELECT *{replace} FROM ({sql.strip()})")


GOLD_DOUBLES = " ".join(f.name for f in schema.GOLD.fields if f.dataType == T.DoubleType())
PREDICTION_DOUBLES = " ".join(
    f.name for f in schema.PREDICTIONS.fields if f.dataType == T.DoubleType())
