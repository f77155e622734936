"""Box scores, player identity and team totals from play-by-play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A

GRAIN = ["season", "week", "player_id", "player_name"]

# The play columns the feature build reads.
PLAY_COLUMNS = [f.name for f in schema.PLAYS.fields]


# box-score column -> play column, per role
_PASSING = {"pass_attempts": "pass_attempt", "completions": "complete_pass",
            "passing_yards": "yards_gained", "passing_tds": "pass_touchdown",
            "interceptions": "interception"}
_RUSHING = {"rush_attempts": "rush_attempt", "rushing_yards": "yards_gained",
            "rushing_tds": "rush_touchdown"}
_RECEIVING = {"targets": "pass_attempt", "receptions": "complete_pass",
              "receiving_yards": "yards_gained", "receiving_tds": "pass_touchdown"}


def _role_rows(plays: DataFrame, role: str) -> DataFrame:
    return plays.withColumnsRenamed({
        f"{role}_player_id": "player_id", f"{role}_player_name": "player_name"})


def _measured(plays: DataFrame, role: str, measures: dict[str, str]) -> DataFrame:
    """One row per play of a role with its box-score measures."""
    return _role_rows(plays, role).select(
        *GRAIN, *[F.col(c).alias(n) for n, c in measures.items()])


def _passes(plays: DataFrame) -> DataFrame:
    """Passing plays, also those without a passer id."""
    return _measured(plays.where(F.col("play_type") == "pass"), "passer", _PASSING)


def _rushes(plays: DataFrame) -> DataFrame:
    return _measured(plays.where(F.col("play_type") == "run"), "rusher", _RUSHING)


def _targets(plays: DataFrame) -> DataFrame:
    """Passing plays with a known receiver: each attempt is a target."""
    targeted = (F.col("play_type") == "pass") & F.col("receiver_player_id").isNotNull()
    return _measured(plays.where(targeted), "receiver", _RECEIVING)


def passer_box(plays: DataFrame) -> DataFrame:
    return A.sums(_passes(plays), GRAIN, **{c: c for c in _PASSING})


def rusher_box(plays: DataFrame) -> DataFrame:
    return A.sums(_rushes(plays), GRAIN, **{c: c for c in _RUSHING})


def receiver_box(plays: DataFrame) -> DataFrame:
    return A.sums(_targets(plays), GRAIN, **{c: c for c in _RECEIVING})


def box_score(plays: DataFrame) -> DataFrame:
    """Merged box score of all roles with fantasy points, NULL ids kept.

    Each play is expanded to the roles it counts for, so all roles share one scan, one
    map-side combine and one shuffle.
    """
    passing, rushing = F.col("play_type") == "pass", F.col("play_type") == "run"
    roles = [("passer", passing, _PASSING), ("rusher", rushing, _RUSHING),
             ("receiver", passing & F.col("receiver_player_id").isNotNull(), _RECEIVING)]
    names = [n for _, _, measures in roles for n in measures]
    nothing = F.lit(None).cast("double")

    def row(role: str, measures: dict[str, str]) -> Column:
        return F.struct(
            F.col(f"{role}_player_id").alias("player_id"),
            F.col(f"{role}_player_name").alias("player_name"),
            *[(F.col(measures[n]) if n in measures else nothing).alias(n) for n in names])

    rows = plays.select("season", "week", F.inline(F.array_compact(F.array(*[
        F.when(counts, row(role, measures)) for role, counts, measures in roles]))))
    merged = rows.groupBy(*GRAIN).agg(
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    return merged.select(*GRAIN, *schema.BOX_COLUMNS, S.ppr_points().alias(schema.TARGET))


def player_mentions(plays: DataFrame) -> DataFrame:
    """UNION ALL of every named role on every play, tagged with the position
    the role implies."""
    parts = []
    for order, (role, position) in enumerate(
            [("passer", "QB"), ("rusher", "RB"), ("receiver", "WR")]):
        rows = _role_rows(plays.where(F.col(f"{role}_player_id").isNotNull()), role)
        parts.append(rows.select(
            "player_id", "player_name", F.col("posteam").alias("team"), "season", "week",
            F.lit(position).alias("position"), F.lit(order).alias("role_order")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def official_positions(rosters: DataFrame) -> DataFrame:
    """Each player's position on the latest roster that states one."""
    return A.last_by(rosters.where(F.col("player_id").isNotNull()), ["player_id"],
                     "position", ["season"])


def player_positions(mentions: DataFrame, rosters: DataFrame) -> DataFrame:
    """Modal role per player, overridden by a skill position on the roster."""
    modal = A.mode_by_count(mentions, "player_id", "position")
    names = A.first_by(mentions, "player_id", "player_name",
                       ["role_order", "season", "week"])
    official = official_positions(rosters).withColumnRenamed("position", "official")
    return (modal.join(names, "player_id", "left").join(official, "player_id", "left")
            .select("player_id", "player_name",
                    F.coalesce(S.roster_position("official"), "position").alias("position")))


def player_teams(mentions: DataFrame) -> DataFrame:
    """Last team per (player, season)."""
    return A.last_by(mentions, ["player_id", "season"], "team", ["week"]).withColumnRenamed(
        "team", "recent_team")


# --------------------------------------------------------------------------
# Single-pass facts: everything the feature build needs from play-by-play
# --------------------------------------------------------------------------

PLAYER, OFFENSE, DEFENSE = "player", "offense", "defense"
OFFENSE_COLUMNS = ["dropbacks", "sacks", "team_total_opportunities",
                   "team_pass_attempts", "team_air_yards"]
DEFENSE_COLUMNS = ["dropbacks", "sacks", "run_yards", "run_plays", "play_yards",
                   "play_count"]


def entity_week_facts(plays: DataFrame) -> DataFrame:
    """All player-week, offense-week and defense-week sums in one shuffle.

    Each play is expanded to the entities it counts for (up to three roles, its
    offense and its defense) and grouped by (kind, entity, season, week, name,
    team). Sums combine before the shuffle, so a hot player or team moves one
    partial row per task, and the plays are scanned once instead of once per
    metric. The player's team is a key rather than a maximum: all buffers stay
    fixed-width, which keeps this a hash aggregation (a string maximum would
    make Spark sort every expanded row first).
    """
    is_pass = F.col("play_type") == "pass"
    is_run = F.col("play_type") == "run"
    never = F.lit(None).cast("string")

    def entity(kind: str, role: str, key: Column, name: Column, boxed: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(role).alias("role"), key.alias("entity"),
            name.alias("player_name"),
            (F.col("posteam") if kind == PLAYER else never).alias("week_team"),
            F.coalesce(boxed, F.lit(False)).alias("boxed"))

    passer, rusher, receiver = (
        [F.col(f"{r}_player_id"), F.col(f"{r}_player_name")]
        for r in ("passer", "rusher", "receiver"))
    expanded = plays.select(
        "season", "week", "play_type", "pass_attempt", "complete_pass",
        "rush_attempt", "yards_gained", "pass_touchdown", "rush_touchdown", "interception",
        "sack", "qb_dropback", "yardline_100", "air_yards",
        F.inline(F.array(
            entity(PLAYER, "QB", *passer, is_pass),
            entity(PLAYER, "RB", *rusher, is_run),
            entity(PLAYER, "WR", *receiver, is_pass & receiver[0].isNotNull()),
            entity(OFFENSE, "", F.col("posteam"), never, F.lit(False)),
            entity(DEFENSE, "", F.col("defteam"), never, F.lit(False))))
    ).where(F.col("entity").isNotNull() | F.col("boxed"))

    kind, role, boxed = F.col("kind"), F.col("role"), F.col("boxed")
    offense, defense = kind == OFFENSE, kind == DEFENSE
    as_role = lambda r, c: F.sum(F.when(boxed & (role == r), F.col(c)))
    dropback = F.col("qb_dropback") == 1
    scrimmage = F.col("play_type").isin("run", "pass")
    red_zone = F.col("yardline_100") <= schema.RED_ZONE
    counted = lambda cond: F.count_if(cond).cast("double")
    return expanded.groupBy(
        "kind", "entity", "season", "week", "player_name", "week_team").agg(
        F.max(boxed).alias("in_box"),
        as_role("QB", "pass_attempt").alias("pass_attempts"),
        as_role("QB", "complete_pass").alias("completions"),
        as_role("QB", "yards_gained").alias("passing_yards"),
        as_role("QB", "pass_touchdown").alias("passing_tds"),
        as_role("QB", "interception").alias("interceptions"),
        as_role("RB", "rush_attempt").alias("rush_attempts"),
        as_role("RB", "yards_gained").alias("rushing_yards"),
        as_role("RB", "rush_touchdown").alias("rushing_tds"),
        as_role("WR", "pass_attempt").alias("targets"),
        as_role("WR", "complete_pass").alias("receptions"),
        as_role("WR", "yards_gained").alias("receiving_yards"),
        as_role("WR", "pass_touchdown").alias("receiving_tds"),
        counted((role == "RB") & is_run & red_zone).alias("hvt_carries"),
        counted((role == "WR") & is_pass & red_zone).alias("hvt_targets"),
        F.sum(F.when(role == "WR", F.col("air_yards"))).alias("player_air_yards"),
        counted(role == "QB").alias("qb_mentions"),
        counted(role == "RB").alias("rb_mentions"),
        counted(role == "WR").alias("wr_mentions"),
        F.sum(F.when((offense | defense) & dropback, F.col("qb_dropback"))).alias("dropbacks"),
        F.sum(F.when((offense | defense) & dropback, F.col("sack"))).alias("sacks"),
        (F.coalesce(F.sum(F.when(offense, F.col("rush_attempt"))), F.lit(0.0))
         + F.coalesce(F.sum(F.when(offense, F.col("pass_attempt"))), F.lit(0.0)))
        .alias("team_total_opportunities"),
        F.coalesce(F.sum(F.when(offense, F.col("pass_attempt"))), F.lit(0.0))
        .alias("team_pass_attempts"),
        F.sum(F.when(offense, F.col("air_yards"))).alias("team_air_yards"),
        F.sum(F.when(defense & is_run, F.col("yards_gained"))).alias("run_yards"),
        counted(defense & is_run).alias("run_plays"),
        F.sum(F.when(defense & scrimmage, F.col("yards_gained"))).alias("play_yards"),
        counted(defense & scrimmage).alias("play_count"),
        F.max(dropback).alias("any_dropback"))


_MENTIONS = {"QB": "qb_mentions", "RB": "rb_mentions", "WR": "wr_mentions"}


def identified_box(facts: DataFrame, rosters: DataFrame) -> DataFrame:
    """Box score rows with position, team per season and filled names.

    Works on ``entity_week_facts``. The rows are distributed by player once;
    the sum over a week's teams, the roster lookup and all windows keep that
    distribution, and the order (player, season, week) left by the sum serves
    every window, so nothing is shuffled or sorted again. A player has one row
    per week here, so no partition grows with the number of plays.
    """
    rows = facts.where((F.col("kind") == PLAYER) & F.col("entity").isNotNull())
    rows = rows.withColumnRenamed("entity", "player_id").repartition("player_id")
    shared = ["hvt_carries", "hvt_targets", "player_air_yards"]
    summed = [*schema.BOX_COLUMNS, *shared, *_MENTIONS.values()]
    rows = rows.groupBy("player_id", "season", "week", "player_name").agg(
        F.max("in_box").alias("in_box"), F.max("week_team").alias("week_team"),
        *[S.total(c).alias(c) for c in summed])
    official = official_positions(rosters).withColumnRenamed("position", "official")
    rows = rows.join(official, "player_id", "left")

    player = Window.partitionBy("player_id")
    player_season = Window.partitionBy("player_id", "season")
    player_week = Window.partitionBy("player_id", "season", "week")
    role_order = F.when(F.col("qb_mentions") > 0, 0).when(F.col("rb_mentions") > 0, 1).otherwise(2)
    named = F.when(F.col("player_name").isNotNull(),
                   F.struct(role_order.alias("r"), "season", "week", "player_name"))
    teamed = F.when(F.col("week_team").isNotNull(), F.struct("week", "week_team"))
    # a player listed under two names in a week shares these between both rows;
    # the finest window comes first so that its order serves the coarser ones
    rows = rows.withColumns({c: F.sum(c).over(player_week) for c in shared})
    rows = rows.withColumn("recent_team", F.max(teamed).over(player_season)["week_team"])
    rows = rows.withColumns({
        **{f"_n_{p}": F.sum(c).over(player) for p, c in _MENTIONS.items()},
        "_first_name": F.min(named).over(player)["player_name"],
    })
    # roles in alphabetical order: the first that reaches the maximum wins a tie
    most = F.greatest("_n_QB", "_n_RB", "_n_WR")
    modal = F.when(F.col("_n_QB") == most, "QB").when(F.col("_n_RB") == most, "RB").otherwise("WR")
    boxed = rows.where("in_box").select(
        "player_id", F.coalesce("player_name", "_first_name").alias("player_name"),
        "season", "week", "recent_team",
        F.coalesce(S.roster_position("official"), modal).alias("position"),
        *schema.BOX_COLUMNS, *shared)
    return boxed.withColumn(schema.TARGET, S.ppr_points())


def offense_weeks(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == OFFENSE).select(
        F.col("entity").alias("team"), "season", "week", "any_dropback", *OFFENSE_COLUMNS)


def defense_weeks(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == DEFENSE).select(
        F.col("entity").alias("team"), "season", "week", "any_dropback", *DEFENSE_COLUMNS)


def unattributed(box: DataFrame) -> DataFrame:
    """How many box rows and points no player id accounts for."""
    return box.where(F.col("player_id").isNull()).agg(
        F.count(F.lit(1)).alias("rows"), S.total(schema.TARGET).alias("points"))
