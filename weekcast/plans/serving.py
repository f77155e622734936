"""The fixed family of parameterised queries over gold and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions.scoring import serving_columns
from weekcast.operators import aggregates as A

PREDICTION_FIELDS = [f.name for f in schema.PREDICTIONS.fields]


# --------------------------------------------------------------------------
# Parameters
# --------------------------------------------------------------------------

def clamp_page(limit: int = schema.PAGE_DEFAULT, offset: int = 0) -> tuple[int, int]:
    return max(1, min(limit, schema.PAGE_MAX)), max(0, offset)


def normalise_code(value: str | None) -> str | None:
    """Trimmed upper-case code; blank means no filter."""
    return value.strip().upper() or None if value is not None else None


# --------------------------------------------------------------------------
# Building blocks
# --------------------------------------------------------------------------

def _newest(*ties: str) -> list[Column]:
    return [F.desc("season"), F.desc("week"), *[F.asc_nulls_last(t) for t in ties]]


def matching(df: DataFrame, position: str | None = None, team: str | None = None,
             min_projected: float | None = None, season: int | None = None) -> DataFrame:
    """Conjunction of the filters that are given; a NULL projection fails a minimum."""
    position, team = normalise_code(position), normalise_code(team)
    if position:
        df = df.where(F.col("position") == position)
    if team:
        df = df.where(F.col("recent_team") == team)
    if min_projected is not None:
        df = df.where(F.col("projected_ppr") >= min_projected)
    if season is not None:
        df = df.where(F.col("season") == season)
    return df


def page(df: DataFrame, order: list[Column], limit: int = schema.PAGE_DEFAULT,
         offset: int = 0) -> DataFrame:
    """One page in a total order, with the size of the whole result.

    The total is a scalar subquery over the filtered rows; counting in an
    unpartitioned window would move every row to one task.
    """
    limit, offset = clamp_page(limit, offset)
    total = df.agg(F.count(F.lit(1)).cast("int").alias("total")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def in_latest_slice(df: DataFrame, newest: tuple[int, int] | None = None) -> DataFrame:
    """Rows of the greatest (season, week).

    ``newest`` is that slice where it is known, as for a table of the catalog. Else it is
    looked up first (one row), so that the table scan that follows is filtered by literals
    and prunes partitions.
    """
    season, week = newest or A.latest_slice(df.select("season", "week")).first()
    return df.where((F.col("season") == F.lit(season)) & (F.col("week") == F.lit(week)))


def latest_appearances(gold: DataFrame, columns: list[str]) -> DataFrame:
    """Newest row per player."""
    return A.keep_one(gold.select(*columns), ["player_id"], _newest("player_name"))


# --------------------------------------------------------------------------
# Players
# --------------------------------------------------------------------------

def list_players(gold: DataFrame, position: str | None = None, team: str | None = None,
                 limit: int = schema.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """Latest appearance per player; the filters apply to that row only."""
    latest = latest_appearances(gold, [
        "player_id", "player_name", "position", "recent_team", "season", "week",
        "opponent", "fantasy_points_ppr"])
    found = matching(latest, position, team).select(
        "player_id", "player_name", "position", "recent_team",
        F.col("season").alias("latest_season"), F.col("week").alias("latest_week"),
        F.col("opponent").alias("latest_opponent"),
        F.col("fantasy_points_ppr").alias("latest_ppr"))
    return page(found, [F.asc_nulls_first("player_name"), F.asc("player_id")], limit, offset)


def career(gold: DataFrame) -> DataFrame:
    """Games, first and last season, mean and best score per player."""
    return gold.groupBy("player_id").agg(
        F.count(F.lit(1)).cast("int").alias("games_played"),
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        F.avg(schema.TARGET).alias("career_ppg"), F.max(schema.TARGET).alias("career_high"))


def get_player(gold: DataFrame, player_id: str) -> DataFrame:
    """Latest row and career of one player; empty for an unknown id."""
    rows = gold.where(F.col("player_id") == player_id)
    latest = A.keep_one(rows, ["player_id"], _newest("player_name"))
    found = latest.join(career(rows), "player_id")
    return found.select(*serving_columns(found))


def player_history(gold: DataFrame, player_id: str, season: int | None = None,
                   limit: int = schema.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    rows = matching(gold.where(F.col("player_id") == player_id), season=season)
    return page(rows, _newest("player_name"), limit, offset)


# --------------------------------------------------------------------------
# Predictions
# --------------------------------------------------------------------------

def _by_projection() -> list[Column]:
    return [F.desc_nulls_last("projected_ppr"), F.asc("player_id")]


def latest_predictions(predictions: DataFrame,
                       newest: tuple[int, int] | None = None) -> DataFrame:
    return in_latest_slice(predictions.select(*PREDICTION_FIELDS), newest).orderBy(
        *_by_projection())


def list_predictions(predictions: DataFrame, position: str | None = None,
                     team: str | None = None, min_projected: float | None = None,
                     limit: int = schema.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    rows = matching(in_latest_slice(predictions.select(*PREDICTION_FIELDS)),
                    position, team, min_projected)
    return page(rows, _by_projection(), limit, offset)


def top_predictions(predictions: DataFrame, n: int, position: str | None = None) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    return list_predictions(predictions, position, limit=n)


def get_prediction(predictions: DataFrame, player_id: str) -> DataFrame:
    """The player's newest projection: the latest slate if present, else older."""
    rows = predictions.select(*PREDICTION_FIELDS).where(F.col("player_id") == player_id)
    return rows.orderBy(*_newest("player_name")).limit(1)


# --------------------------------------------------------------------------
# Weeks and teams
# --------------------------------------------------------------------------

def week_stats(gold: DataFrame, season: int, week: int, position: str | None = None,
               team: str | None = None, limit: int = schema.PAGE_DEFAULT,
               offset: int = 0) -> DataFrame:
    rows = gold.where((F.col("season") == season) & (F.col("week") == week))
    return page(matching(rows, position, team),
                [F.desc_nulls_last(schema.TARGET), F.asc("player_id")], limit, offset)


def latest_week(gold: DataFrame, position: str | None = None, team: str | None = None,
                limit: int = schema.PAGE_DEFAULT, offset: int = 0,
                newest: tuple[int, int] | None = None) -> DataFrame:
    return page(matching(in_latest_slice(gold, newest), position, team),
                [F.desc_nulls_last(schema.TARGET), F.asc("player_id")], limit, offset)


def latest_on_team(gold: DataFrame, team: str) -> DataFrame:
    """Newest row per player among the rows on this team."""
    columns = ["player_id", "player_name", "position", "recent_team", "opponent",
               "season", "week", "fantasy_points_ppr", "depth_chart_rank"]
    return latest_appearances(matching(gold, team=team), columns)


def team_roster(gold: DataFrame, predictions: DataFrame, team: str) -> DataFrame:
    """Roster left-joined to the latest slate; no slate means no projections."""
    roster = latest_on_team(gold, team).alias("r")
    slate, r = in_latest_slice(predictions), F.col
    joined = roster.join(
        slate.alias("p"), r("p.player_id") == r("r.player_id"), "left")
    either = lambda c: F.coalesce(r(f"p.{c}"), r(f"r.{c}")).alias(c)
    return joined.select(
        "r.player_id", "r.player_name", "r.position", "r.recent_team",
        either("opponent"), either("season"), either("week"),
        "p.projected_ppr", "p.actual_ppr", "p.insight", "p.insight_source",
        r("r.fantasy_points_ppr").alias("latest_ppr"), either("depth_chart_rank"),
    ).orderBy(F.desc_nulls_last("projected_ppr"), F.asc_nulls_last("player_name"),
              F.asc("player_id"))
