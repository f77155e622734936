"""The gold feature table: one wide row per player and week played."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A
from weekcast.operators import joins as J
from weekcast.operators import windows as W
from weekcast.plans import boxscore as B
from weekcast.plans.context import game_context
from weekcast.session import stage
from weekcast.sources.sinks import conform

PLAYER_WEEK = ["player_id", "season", "week"]
TEAM_WEEK = ["team", "season", "week"]

# metric -> (prefix of its averages, positions that carry them; None = all)
ROLLING = {
    "fantasy_points_ppr": ("fantasy_points", None),
    "pass_attempts": ("qb_pass_attempts", ["QB"]),
    "rushing_yards": ("qb_rushing_yards", ["QB"]),
    "opportunity_share": ("rb_opportunity_share", ["RB"]),
    "total_hvts": ("rb_hvts", ["RB"]),
    "snap_share": ("rb_snap_share", ["RB"]),
    "target_share": ("wr_te_target_share", ["WR", "TE"]),
    "air_yards_share": ("wr_te_air_yards_share", ["WR", "TE"]),
    "wopr": ("wr_te_wopr", ["WR", "TE"]),
}


def rolling_name(metric: str, n: int) -> str:
    return f"{ROLLING[metric][0]}_{n}wk_avg"


@dataclass(frozen=True)
class Sources:
    """The seven input tables of the feature build."""

    plays: DataFrame
    schedules: DataFrame
    snap_counts: DataFrame
    injuries: DataFrame
    rosters: DataFrame
    depth_weekly: DataFrame
    depth_snapshots: DataFrame


# --------------------------------------------------------------------------
# Player-week side metrics
# --------------------------------------------------------------------------

def snap_shares(snap_counts: DataFrame, rosters: DataFrame) -> DataFrame:
    """Best snap share per player-week, ids mapped from the snap source."""
    ids = A.keep_one(
        rosters.where(F.col("player_id").isNotNull() & F.col("pfr_id").isNotNull())
        .select("player_id", "pfr_id"), ["pfr_id"], [F.asc("player_id")])
    mapped = J.lookup(snap_counts, ids, {"pfr_player_id": "pfr_id"}, how="inner")
    return mapped.groupBy(*PLAYER_WEEK).agg(F.max("offense_pct").alias("snap_share"))


def weekly_ranks(depth_weekly: DataFrame) -> DataFrame:
    """Best numeric rank per player-week on the offensive weekly lists."""
    listed = depth_weekly.where(
        (F.col("formation") == "Offense") & F.col("position").isin(schema.DEPTH_POSITIONS)
        & F.col("gsis_id").isNotNull())
    return listed.groupBy(F.col("gsis_id").alias("player_id"), "season", "week").agg(
        F.min(S.to_int("depth_team")).alias("rank_weekly"))


def snapshot_ranks(depth_snapshots: DataFrame) -> DataFrame:
    """Best rank per player and snapshot day."""
    listed = depth_snapshots.where(
        F.col("pos_abb").isin(schema.DEPTH_POSITIONS) & F.col("gsis_id").isNotNull())
    return listed.groupBy(
        F.col("gsis_id").alias("player_id"), S.day("dt").alias("snapshot_day")).agg(
        F.min("pos_rank").alias("rank_snapshot"))


def out_players(injuries: DataFrame) -> DataFrame:
    return injuries.where(
        F.col("report_status").isin(schema.OUT_STATUSES) & F.col("gsis_id").isNotNull()
    ).select(F.col("gsis_id").alias("player_id"), "season", "week").distinct()


# --------------------------------------------------------------------------
# Team-week tables
# --------------------------------------------------------------------------

def sack_rates(facts: DataFrame, out: str) -> DataFrame:
    """Shifted season-to-date sacks per dropback of weeks with a dropback."""
    weeks = facts.where("any_dropback")
    return weeks.select(*TEAM_WEEK, W.season_to_date_rate(
        "sacks", "dropbacks", ["team"]).alias(out))


def yard_rates(defense: DataFrame, yards: str, plays: str, out: str) -> DataFrame:
    """Shifted season-to-date yards per play of weeks with such a play."""
    weeks = defense.where(F.col(plays) > 0)
    return weeks.select(*TEAM_WEEK, W.season_to_date_rate(yards, plays, ["team"]).alias(out))


def points_allowed(players: DataFrame) -> DataFrame:
    """Shifted mean of the points a defence gave up to a position per week."""
    allowed = players.where(
        F.col("opponent").isNotNull() & F.col("position").isNotNull()
    ).groupBy(F.col("opponent").alias("team"), "season", "week", "position").agg(
        F.sum(schema.TARGET).alias("points"))
    return allowed.select(
        *TEAM_WEEK, "position",
        W.season_to_date_mean("points", ["team", "position"]).alias("opp_def_ppg_allowed"))


def quarterback_efficiency(players: DataFrame, starters: DataFrame | None = None) -> DataFrame:
    """Shifted season-to-date adjusted yards per attempt of every passer, or
    of those whose id is in ``starters`` (one column, player_id)."""
    before = lambda c: W.prior_total(c, ["player_id"])
    passers = players.where(F.col("pass_attempts") > 0)
    if starters is not None:
        passers = passers.join(starters.distinct(), "player_id", "left_semi")
    return passers.select(
        *PLAYER_WEEK, S.adjusted_yards_per_attempt(
            before("passing_yards"), before("passing_tds"), before("interceptions"),
            before("pass_attempts")).alias("starting_qb_aya"))


def receiver_grid(players: DataFrame, calendar: DataFrame) -> DataFrame:
    """Targets of every WR on every week of the season, played or not.

    The team is fixed per (player, season), so it rides along as a key.
    """
    receivers = players.where(F.col("position") == "WR")
    return W.densify(
        receivers.select(*PLAYER_WEEK, F.col("recent_team").alias("team"), "targets"),
        ["player_id", "team"], "targets", calendar=calendar)


def leading_receivers(grid: DataFrame) -> DataFrame:
    """Top two WRs of each team-week by targets before that week."""
    ranked = grid.where(F.col("team").isNotNull()).select(
        *PLAYER_WEEK, "team", W.prior_total("targets", ["player_id"]).alias("prior_targets"))
    return A.top_per_group(
        ranked, ["team", "season", "week"],
        [F.desc("prior_targets"), F.asc("player_id")], 2, rank="wr_rank")


def receiver_health(leaders: DataFrame, out: DataFrame) -> DataFrame:
    """1 when neither leading WR of the team-week is out or doubtful."""
    flagged = leaders.join(out.withColumn("is_out", F.lit(1)), PLAYER_WEEK, "left")
    return flagged.groupBy(*TEAM_WEEK).agg(
        S.flag(F.coalesce(F.sum("is_out"), F.lit(0)) == 0).alias("wr1_wr2_healthy"))


def team_weeks(games: DataFrame, facts: DataFrame) -> DataFrame:
    """Game context, team totals and both sides' shifted rates per team-week.

    Everything here is at team grain, so attaching the opponent's and the
    quarterback's values happens before any player row is touched and the
    player table needs a single join for all of it.
    """
    offense, defense = B.offense_weeks(facts), B.defense_weeks(facts)
    own = J.outer_all([
        games.where(F.col("team").isNotNull()),
        offense.select(*TEAM_WEEK, "team_total_opportunities", "team_pass_attempts",
                       "team_air_yards"),
        sack_rates(offense, "team_sack_rate_allowed"),
    ], TEAM_WEEK)
    faced = J.outer_all([
        sack_rates(defense, "opp_def_sack_rate"),
        yard_rates(defense, "run_yards", "run_plays", "opp_def_ypc_allowed"),
        yard_rates(defense, "play_yards", "play_count", "opp_def_ypp_allowed"),
    ], TEAM_WEEK)
    return J.lookup(own, faced, {"opponent": "team", "season": "season", "week": "week"})


def _by_position(df: DataFrame, value: str) -> DataFrame:
    """One column per known position (positions are a fixed list of four)."""
    return df.groupBy(*TEAM_WEEK).agg(*[
        F.max(F.when(F.col("position") == p, F.col(value))).alias(f"_{value}_{p}")
        for p in schema.POSITIONS])


def _pick_position(value: str) -> Column:
    return F.coalesce(*[
        F.when(F.col("position") == p, F.col(f"_{value}_{p}")) for p in schema.POSITIONS],
        F.lit(0.0))


# --------------------------------------------------------------------------
# Gold
# --------------------------------------------------------------------------

def with_shares(df: DataFrame) -> DataFrame:
    """Opportunity, target and air-yard shares, high-value touches, WOPR."""
    df = df.withColumns({
        "player_opportunities": S.opportunities(),
        "total_hvts": F.col("hvt_carries") + F.col("hvt_targets"),
        "target_share": S.ratio("targets", "team_pass_attempts"),
        "air_yards_share": S.ratio("player_air_yards", "team_air_yards"),
    })
    return df.withColumns({
        "opportunity_share": S.ratio("player_opportunities", "team_total_opportunities"),
        "wopr": S.wopr("target_share", "air_yards_share"),
    })


def with_form(df: DataFrame) -> DataFrame:
    """Rolling averages, games counted and last-season carry-over."""
    df = W.blended_means(df, list(ROLLING), schema.WINDOWS, entity="player_id",
                         name=rolling_name)
    ppg, games = W.previous_season_summary(schema.TARGET, "player_id")
    masked = {}
    for metric, (_, positions) in ROLLING.items():
        if positions:
            for n in schema.WINDOWS:
                name = rolling_name(metric, n)
                masked[name] = F.when(F.col("position").isin(positions), F.col(name))
    return df.withColumns({
        **masked,
        "rolling_games_count": W.games_before("player_id", max(schema.WINDOWS)),
        "prev_season_ppg": ppg,
        "prev_season_games": games,
    })


def starters_only(df: DataFrame) -> DataFrame:
    """QB and TE rows must be ranked first; other positions keep all ranks."""
    single = F.coalesce(F.col("position").isin(schema.STARTER_ONLY_POSITIONS), F.lit(False))
    return df.where(~single | (F.col("depth_chart_rank") == 1))


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=schema.GOLD_FILL_ZERO)


def with_player_side(rows: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """``rows`` (of known players) with the values of tables that have one row per player-week.

    All are united and distributed by player once; a window over the player-week hands the
    values to its rows. Later windows by player keep that distribution and order, whereas a
    join by player-week would shuffle the rows once more. NULL keys match nothing.
    """
    added = [c for part in parts for c in part.columns if c not in PLAYER_WEEK]
    merged = rows.withColumn("_row", F.lit(True))
    for part in parts:
        merged = merged.unionByName(part.dropna(subset=PLAYER_WEEK), allowMissingColumns=True)
    same = Window.partitionBy(*PLAYER_WEEK)
    return merged.repartition("player_id").withColumns(
        {c: F.max(c).over(same) for c in added}).where("_row").drop("_row")


def unattributed_rows(facts: DataFrame) -> DataFrame:
    """Gold rows of plays without a player id: a box score and no history.

    They share one NULL key, so they never enter a window by player; every
    feature that needs an identity has its empty value.
    """
    rows = facts.where((F.col("kind") == B.PLAYER) & F.col("entity").isNull()
                       & F.col("in_box"))
    rows = rows.groupBy("season", "week", "player_name").agg(
        *[S.total(c).alias(c) for c in schema.BOX_COLUMNS])
    rows = with_shares(rows.withColumns({
        schema.TARGET: S.ppr_points(), "wr1_wr2_healthy": F.lit(1),
        "rolling_games_count": F.lit(0), "depth_chart_rank": F.lit(schema.GOLD_UNLISTED_RANK),
        **{c: F.lit(0.0) for c in ("hvt_carries", "hvt_targets", "player_air_yards")},
        **{c: F.lit(None).cast("double") for c in B.OFFENSE_COLUMNS if c.startswith("team_")},
    }))
    return conform(rows, schema.GOLD)


def build_gold(src: Sources, *, starters: bool = True, staged: bool = True,
               keep_unattributed: bool = True) -> DataFrame:
    """The 73-column feature table.

    Plays without a player id have rows too: a box score, and no history, team or
    position; they are no starters of any team and stay. ``keep_unattributed=False``
    leaves them out.

    Cut points (written tables when ``staged``): the single-pass facts, the
    identified box score, and the team-week table. The player rows then take
    part in one join (team-week) and one distribution by player, which the snap
    shares, ranks and all rolling, carry-over and fill windows share.
    """
    cut = stage if staged else (lambda df, _name, _partition_by=None: df)
    facts = cut(B.entity_week_facts(src.plays), "facts", "kind")
    players = cut(B.identified_box(facts, src.rosters), "players")
    games = game_context(src.schedules)

    # players are summed to their team before the opponent is looked up, so
    # the join sees team rows only
    scored = players.groupBy("season", "week", "recent_team", "position").agg(
        F.sum(schema.TARGET).alias(schema.TARGET))
    faced = J.lookup(scored, games.select("season", "week", "team", "opponent"),
                     {"season": "season", "week": "week", "recent_team": "team"})
    allowed = _by_position(points_allowed(faced), "opp_def_ppg_allowed")
    grid = receiver_grid(players, games_calendar(players))
    health = receiver_health(leading_receivers(grid), out_players(src.injuries))

    own = team_weeks(games, facts)
    own = J.lookup(own, allowed, {"opponent": "team", "season": "season", "week": "week"})
    own = own.join(health, TEAM_WEEK, "left")
    starting = games.select(F.col("starting_qb_id").alias("player_id"))
    own = J.lookup(own, quarterback_efficiency(players, starting),
                   {"starting_qb_id": "player_id", "season": "season", "week": "week"})
    own = cut(own, "team_weeks")

    rows = J.lookup(players, own, {"season": "season", "week": "week", "recent_team": "team"})
    dated = J.asof_backward(
        J.lookup(players.select(*PLAYER_WEEK, "recent_team"),
                 own.select(*TEAM_WEEK, "gameday").where("gameday IS NOT NULL"),
                 {"season": "season", "week": "week", "recent_team": "team"}, how="inner"),
        snapshot_ranks(src.depth_snapshots), "player_id", "gameday", "snapshot_day",
        "rank_snapshot").select(*PLAYER_WEEK, "rank_snapshot")
    rows = with_player_side(rows, [snap_shares(src.snap_counts, src.rosters),
                                   weekly_ranks(src.depth_weekly), dated])

    rows = with_shares(rows.withColumn("snap_share", F.coalesce("snap_share", F.lit(0.0))))
    rows = rows.withColumns({
        "opp_def_ppg_allowed": _pick_position("opp_def_ppg_allowed"),
        "depth_chart_rank": F.coalesce("rank_weekly", "rank_snapshot"),
        "wr1_wr2_healthy": F.coalesce("wr1_wr2_healthy", F.lit(1)),
        "starting_qb_aya": F.coalesce("starting_qb_aya", F.lit(0.0)),
    })
    rows = with_form(rows).withColumn("depth_chart_rank", W.carry_forward(
        "depth_chart_rank", ["player_id", "season"], default=schema.GOLD_UNLISTED_RANK))
    if starters:
        rows = starters_only(rows)
    rows = conform(rows, schema.GOLD)
    if keep_unattributed:
        rows = rows.unionByName(unattributed_rows(facts))
    return fill_zero(rows)


def games_calendar(players: DataFrame) -> DataFrame:
    return players.select("season", "week").distinct()
