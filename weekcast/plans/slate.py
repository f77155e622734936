"""Feature rows and prediction rows for games that have not been played."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A
from weekcast.operators import joins as J
from weekcast.operators import windows as W
from weekcast.plans import features as FT
from weekcast.plans.context import slate_context
from weekcast.sources.sinks import conform

COLD_STARTS = ("blend", "zero")
PLAY_BASED_RATES = ["opp_def_sack_rate", "team_sack_rate_allowed", "opp_def_ypc_allowed",
                    "opp_def_ypp_allowed"]
OUTPUT_CONTEXT = [*schema.PREDICTION_CONTEXT, "missing_vegas_lines"]


def before(gold: DataFrame, season: int, week: int) -> DataFrame:
    return gold.where((F.col("season") < season)
                      | ((F.col("season") == season) & (F.col("week") < week)))


# --------------------------------------------------------------------------
# Who plays
# --------------------------------------------------------------------------

def first_gameday(schedules: DataFrame, season: int, week: int) -> Column:
    """The day of the week's first game, as a scalar subquery."""
    games = schedules.where((F.col("season") == season) & (F.col("week") == week))
    return games.agg(F.min(F.col("gameday").cast("date"))).scalar()


def latest_depth_ranks(depth_snapshots: DataFrame, season: int | None = None,
                       as_of: Column | str | None = None) -> DataFrame:
    """Best rank of each player on their newest snapshot (to the instant).

    Only snapshots of the season are read (their ISO text is compared, so the filter
    reaches the scan), and with ``as_of`` only those up to that day.
    """
    listed = depth_snapshots.where(
        F.col("pos_abb").isin(schema.DEPTH_POSITIONS) & F.col("gsis_id").isNotNull())
    if season is not None:
        listed = listed.where((F.col("dt") >= str(season)) & (F.col("dt") < str(season + 1)))
    if as_of is not None:
        day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
        listed = listed.where(S.day("dt") <= day)
    ranks = listed.groupBy(
        F.col("gsis_id").alias("player_id"), S.instant("dt").alias("at")).agg(
        F.min("pos_rank").alias("pos_rank"))
    return A.keep_one(ranks, ["player_id"], [F.desc("at")]).select("player_id", "pos_rank")


def eligible_roster(rosters: DataFrame, depth_snapshots: DataFrame, season: int,
                    as_of: Column | str | None = None) -> DataFrame:
    """Skill players of the season; QB and TE only when ranked first on the newest
    depth chart of the season (up to ``as_of``). Players without one rank last."""
    listed = rosters.where(
        (F.col("season") == season) & F.col("position").isin(schema.POSITIONS)
    ).select("player_id", F.col("full_name").alias("player_name"), "position", "team")
    ranked = listed.join(latest_depth_ranks(depth_snapshots, season, as_of),
                         "player_id", "left").withColumn(
        "depth_chart_rank",
        F.coalesce("pos_rank", F.lit(schema.SLATE_UNLISTED_RANK))).drop("pos_rank")
    return FT.starters_only(ranked)


# --------------------------------------------------------------------------
# What is known before kickoff
# --------------------------------------------------------------------------

def carryover(gold: DataFrame, season: int, max_week: int | None = None) -> DataFrame:
    """Mean and non-null game count of the season before."""
    rows = gold.where(F.col("season") == season - 1)
    if max_week is not None:
        rows = rows.where(F.col("week") <= max_week)
    return rows.groupBy("player_id").agg(
        F.avg(schema.TARGET).alias("prev_season_ppg"),
        F.count(schema.TARGET).cast("double").alias("prev_season_games"))


def last_games(gold: DataFrame, season: int, n: int, value: str) -> DataFrame:
    """Sum and non-null count of each player's last n games of a season."""
    last = A.top_per_group(
        gold.where(F.col("season") == season).select("player_id", "week", value),
        ["player_id"], [F.desc("week")], n)
    return last.groupBy("player_id").agg(
        S.total(value).alias("recent_sum"), F.count(value).alias("recent_games"))


def points_allowed_per_row(gold: DataFrame, season: int, week: int) -> DataFrame:
    """Mean per opposing player row: the slate definition, unlike gold's
    per-week sums."""
    rows = gold.where((F.col("season") == season) & (F.col("week") < week)
                      & F.col("opponent").isNotNull() & F.col("position").isNotNull())
    return rows.groupBy("opponent", "position").agg(
        F.avg(schema.TARGET).alias("opp_def_ppg_allowed"))


def passer_efficiency(gold: DataFrame, season: int, week: int) -> DataFrame:
    """Adjusted yards per attempt of last week's QBs, with their team."""
    rows = gold.where((F.col("season") == season) & (F.col("week") == week - 1)
                      & (F.col("position") == "QB"))
    return rows.select(
        F.col("player_id").alias("starting_qb_id"), F.col("recent_team").alias("team"),
        "pass_attempts",
        S.adjusted_yards_per_attempt("passing_yards", "passing_tds", "interceptions",
                                     "pass_attempts").alias("starting_qb_aya"))


def team_passers(passers: DataFrame) -> DataFrame:
    """One QB per team: most attempts, then id, so no slate row is doubled."""
    return A.keep_one(passers.where(F.col("team").isNotNull()), ["team"],
                      [F.desc("pass_attempts"), F.asc("starting_qb_id")])


def with_passers(slate: DataFrame, passers: DataFrame) -> DataFrame:
    """Team QB's efficiency for everyone; QBs carry their own id and value."""
    by_team = team_passers(passers).select("team", "starting_qb_id", "starting_qb_aya")
    own = passers.select(
        F.col("starting_qb_id").alias("player_id"), F.col("starting_qb_aya").alias("own_aya"))
    slate = J.lookup(slate, by_team, {"recent_team": "team"}).join(own, "player_id", "left")
    is_qb = F.col("position") == "QB"
    return slate.withColumns({
        "starting_qb_id": F.when(is_qb, F.col("player_id")).otherwise(F.col("starting_qb_id")),
        "starting_qb_aya": F.coalesce(
            F.when(is_qb, F.col("own_aya")).otherwise(F.col("starting_qb_aya")), F.lit(0.0)),
    }).drop("own_aya")


def with_form(slate: DataFrame, gold: DataFrame, season: int, week: int,
              cold_start: str = "blend") -> DataFrame:
    """Rolling features of the slate rows from the games before them.

    The slate rows join the history of their own players and the shared
    rolling window is evaluated over the union, so training and serving use
    one definition. Only this and the last season can matter, so older history
    is pruned at the scan. With ``cold_start="zero"`` a player without a game
    this season gets 0 instead of last season's mean.
    """
    if cold_start not in COLD_STARTS:
        raise ValueError(f"cold_start must be one of {COLD_STARTS}")
    metrics = list(FT.ROLLING)
    keys = ["player_id", "season", "week"]
    history = before(gold, season, week).where(F.col("season") >= season - 1).select(
        *keys, *metrics).join(slate.select("player_id").distinct(), "player_id", "left_semi")
    rows = history.withColumn("_slate", F.lit(False)).unionByName(
        slate.select("player_id", F.lit(season).alias("season"), F.lit(week).alias("week"),
                     F.lit(True).alias("_slate")), allowMissingColumns=True)
    rows = W.blended_means(rows, metrics, schema.WINDOWS, entity="player_id",
                           name=FT.rolling_name)
    rows = rows.withColumn("rolling_games_count", W.games_before(
        "player_id", max(schema.WINDOWS)))
    names = [FT.rolling_name(m, n) for m in metrics for n in schema.WINDOWS]
    if cold_start == "zero":
        rows = rows.withColumns({c: F.when(
            F.col("rolling_games_count") > 0, F.col(c)).otherwise(0.0) for c in names})
    form = rows.where("_slate").select("player_id", *names, "rolling_games_count")
    return slate.join(form, "player_id", "left")


# --------------------------------------------------------------------------
# Slates
# --------------------------------------------------------------------------

def neutral_rates(slate: DataFrame) -> DataFrame:
    """Rates that need play-by-play of the season are 0, receivers healthy."""
    return slate.withColumns({
        **{c: F.lit(0.0) for c in PLAY_BASED_RATES}, "wr1_wr2_healthy": F.lit(1)})


def roster_in_context(rosters: DataFrame, depth_snapshots: DataFrame, schedules: DataFrame,
                      gold: DataFrame, season: int, week: int,
                      carryover_max_week: int | None) -> DataFrame:
    """Eligible players of teams with a game, with carry-over; byes drop out."""
    as_of = first_gameday(schedules, season, week)
    roster = eligible_roster(rosters, depth_snapshots, season, as_of).join(
        carryover(gold, season, carryover_max_week), "player_id", "left").fillna(
        0.0, subset=["prev_season_ppg", "prev_season_games"])
    slate = roster.join(slate_context(schedules, season, week), "team")
    return slate.withColumnRenamed("team", "recent_team").withColumns(
        {"season": F.lit(season), "week": F.lit(week)})


def build_slate(gold: DataFrame, schedules: DataFrame, rosters: DataFrame,
                depth_snapshots: DataFrame, season: int, week: int,
                cold_start: str = "blend") -> DataFrame:
    """Slate of a week with at least one week of the season played."""
    slate = roster_in_context(rosters, depth_snapshots, schedules, gold, season, week,
                              schema.FANTASY_MAX_WEEK)
    slate = with_form(slate, gold, season, week, cold_start)
    slate = slate.join(points_allowed_per_row(gold, season, week),
                       ["opponent", "position"], "left").fillna(
        0.0, subset=["opp_def_ppg_allowed"])
    slate = with_passers(slate, passer_efficiency(gold, season, week))
    return neutral_rates(slate)


def build_opening_slate(gold: DataFrame, schedules: DataFrame, rosters: DataFrame,
                        depth_snapshots: DataFrame, season: int) -> DataFrame:
    """Slate of week 1: no in-season form, rest or efficiency exists yet, and
    the carry-over counts every week of the last season."""
    slate = roster_in_context(rosters, depth_snapshots, schedules, gold, season, 1, None)
    names = [FT.rolling_name(m, n) for m in FT.ROLLING for n in schema.WINDOWS]
    zero = [*names, *PLAY_BASED_RATES, "opp_def_ppg_allowed", "starting_qb_aya",
            "rest_advantage"]
    return slate.withColumns({
        **{c: F.lit(0.0) for c in zero}, "rolling_games_count": F.lit(0),
        "wr1_wr2_healthy": F.lit(0)})


def slate_output(scored: DataFrame) -> DataFrame:
    """Identifiers, projection (not below 0, 1 decimal) and context columns."""
    return scored.select(
        "player_id", "player_name", "recent_team", "position", "opponent", "season", "week",
        S.round_even(S.at_least_zero("prediction"), 1).alias("projected_ppr"),
        *OUTPUT_CONTEXT)


def to_predictions(output: DataFrame) -> DataFrame:
    """Match the predictions table: cast, drop extras, NULL what is not known."""
    return conform(output, schema.PREDICTIONS)


def slate_report(slate: DataFrame) -> DataFrame:
    """Rows, missing lines and non-zero form counts per position."""
    nonzero = ["fantasy_points_3wk_avg", "rb_opportunity_share_3wk_avg",
               "wr_te_target_share_3wk_avg"]
    return slate.groupBy("position").agg(
        F.count(F.lit(1)).alias("players"),
        F.sum("missing_vegas_lines").alias("missing_lines"),
        *[F.count_if(F.col(c) != 0).alias(f"nonzero_{c}") for c in nonzero])
