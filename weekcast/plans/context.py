"""Game context: one row per team and game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import joins as J
from weekcast.operators import windows as W

GAME_KEYS = ["season", "week"]


def team_games(schedules: DataFrame) -> DataFrame:
    """Each game as its home row and its away row (spread sign flipped).

    One scan: both rows come from expanding an array of two structs.
    """
    def side(me: str, other: str, home: int, spread) -> F.Column:
        return F.struct(
            F.col(f"{me}_team").alias("team"), F.col(f"{other}_team").alias("opponent"),
            F.lit(home).alias("is_home"), spread.alias("team_spread"),
            F.col(f"{me}_moneyline").alias("moneyline"),
            F.col(f"{me}_qb_id").alias("starting_qb_id"))

    spread = F.col("spread_line")
    return schedules.select(
        "season", "week", "gameday", "total_line", "roof", "temp", "wind",
        F.inline(F.array(side("home", "away", 1, spread),
                         side("away", "home", 0, F.lit(0.0) - spread))))


def with_rest(games: DataFrame) -> DataFrame:
    """Days since each side's previous game of the season, and the difference."""
    games = games.withColumn(
        "days_since_last_game", W.days_since_previous("gameday", ["team", "season"]))
    games = J.opponent_value(games, GAME_KEYS, "team", "opponent", "days_since_last_game",
                             "opp_days_since_last_game")
    return games.withColumn("rest_advantage", F.coalesce(
        (F.col("days_since_last_game") - F.col("opp_days_since_last_game")).cast("double"),
        F.lit(0.0)))


def game_context(schedules: DataFrame) -> DataFrame:
    """Lines, win probability, weather, venue and rest per team and game."""
    games = team_games(schedules).withColumn("gameday", F.to_date("gameday"))
    games = games.withColumns({
        "implied_total": S.implied_total("total_line", "team_spread"),
        "team_win_prob": S.moneyline_probability("moneyline"),
        "is_dome": S.is_dome("roof"),
    }).withColumn("is_bad_weather", S.is_bad_weather())
    return with_rest(games).select(
        "season", "week", "team", "opponent", "gameday", *schema.CONTEXT_COLUMNS,
        "starting_qb_id")


def slate_context(schedules: DataFrame, season: int, week: int) -> DataFrame:
    """Context of a week not yet played: missing lines get defaults, weather is
    neutral, and rest counts from the previous week's game."""
    year = schedules.where(F.col("season") == season)
    games = team_games(year.where(F.col("week") == week))
    context = games.select(
        "team", "opponent", "is_home",
        S.implied_total(F.coalesce("total_line", F.lit(schema.DEFAULT_TOTAL)),
                        F.coalesce("team_spread", F.lit(schema.DEFAULT_SPREAD))
                        ).alias("implied_total"),
        F.coalesce("team_spread", F.lit(schema.DEFAULT_SPREAD)).alias("team_spread"),
        S.moneyline_probability("moneyline", zero_is_underdog=False).alias("team_win_prob"),
        S.is_dome("roof").alias("is_dome"),
        F.lit(schema.NEUTRAL_TEMP).alias("temp"), F.lit(schema.NEUTRAL_WIND).alias("wind"),
        F.lit(0).alias("is_bad_weather"),
        F.col("team_spread").isNull().cast("int").alias("missing_vegas_lines"))
    rest = rest_days(year, week)
    context = J.lookup(context, rest, {"team": "team"})
    context = J.lookup(context, rest.withColumnRenamed("rest_days", "opp_rest_days"),
                       {"opponent": "team"})
    return context.withColumn("rest_advantage", F.coalesce(
        (F.col("rest_days") - F.col("opp_rest_days")).cast("double"), F.lit(0.0))
    ).drop("rest_days", "opp_rest_days")


def last_game_dates(schedules: DataFrame, week: int) -> DataFrame:
    """Latest date of each team in a week, from both sides of the schedule."""
    games = schedules.where(F.col("week") == week).withColumn("gameday", F.to_date("gameday"))
    sides = games.select(F.col("home_team").alias("team"), "gameday").unionByName(
        games.select(F.col("away_team").alias("team"), "gameday"))
    return sides.groupBy("team").agg(F.max("gameday").alias("gameday"))


def rest_days(schedules: DataFrame, week: int) -> DataFrame:
    before = last_game_dates(schedules, week - 1).withColumnRenamed("gameday", "last_game_date")
    now = last_game_dates(schedules, week).withColumnRenamed("gameday", "this_game_date")
    return before.join(now, "team").select(
        "team", S.days_between("this_game_date", "last_game_date").alias("rest_days"))
