"""Adapter: derive the domain tables from an order-shipment star schema.

One shipment line is one play. Suppliers pass and rush, a part-derived id
receives, nations are teams, ship year and month are season and week. Every
derived table is computed by Spark from the star tables, so its size follows
theirs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
LAST_WEEKLY_SEASON = 1998
PLAY_TYPES = {"R": "pass", "A": "run", "N": "no_play"}
HOME_TEAMS = 12


def _player(key: Column) -> Column:
    return F.concat(F.lit("P"), key.cast("string"))


def _player_name(player_id: str) -> Column:
    return F.concat(F.lit("Player "), F.substring(player_id, 2, 20))


def _team(key: Column) -> Column:
    return F.concat(F.lit("T"), key.cast("string"))


def _position(suppkey: str = "l_suppkey") -> Column:
    names = ["QB", "RB", "WR", "TE", "FB", "K"]
    kind = F.col(suppkey) % 6
    out = F.when(kind == 0, names[0])
    for i, n in enumerate(names[1:], start=1):
        out = out.when(kind == i, n)
    return out


@dataclass(frozen=True)
class StarTables:
    """Lazy domain tables over ``<folder>/<table>.parquet``."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            "*", F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"))

    def plays(self, columns: Iterable[str] | None = None) -> DataFrame:
        """Play-by-play with the requested columns.

        Only the dimension tables those columns need are joined: posteam needs
        suppliers, defteam orders and customers, yardline_100 parts.
        """
        wanted = None if columns is None else set(columns)
        need = lambda c: wanted is None or c in wanted
        lines = self._lines
        if need("posteam"):
            lines = lines.join(self.raw("supplier").select(
                F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
        if need("defteam"):
            orders = self.raw("orders").select(
                F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
            customers = self.raw("customer").select("c_custkey", "c_nationkey")
            lines = lines.join(orders.join(customers, "c_custkey", "left"), "l_orderkey", "left")
        if need("yardline_100"):
            lines = lines.join(self.raw("part").select(
                F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
        passing, rushing = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
        idle = F.col("l_returnflag") == "N"
        number = lambda c: c.cast("int").cast("double")
        ids = {
            "passer_player_id": F.when(
                (passing & (F.col("l_linenumber") != 7))
                | (idle & (F.col("l_linenumber") == 2)), _player(F.col("l_suppkey"))),
            "rusher_player_id": F.when(rushing, _player(F.col("l_suppkey"))),
            "receiver_player_id": F.when(
                passing & (F.col("l_linenumber") != 1),
                _player(F.floor(F.col("l_partkey") / 20) + 1)),
        }
        lines = lines.withColumns({k: v for k, v in ids.items()})
        kind = F.when(passing, PLAY_TYPES["R"]).when(rushing, PLAY_TYPES["A"]).otherwise(
            PLAY_TYPES["N"])
        expressions = {
            "season": lambda: F.col("season"),
            "week": lambda: F.col("week"),
            "play_type": lambda: kind,
            "posteam": lambda: _team(F.col("s_nationkey")),
            "defteam": lambda: _team(F.col("c_nationkey")),
            "passer_player_id": lambda: F.col("passer_player_id"),
            "passer_player_name": lambda: _player_name("passer_player_id"),
            "rusher_player_id": lambda: F.col("rusher_player_id"),
            "rusher_player_name": lambda: _player_name("rusher_player_id"),
            "receiver_player_id": lambda: F.col("receiver_player_id"),
            "receiver_player_name": lambda: _player_name("receiver_player_id"),
            "pass_attempt": lambda: number(passing),
            "complete_pass": lambda: number(F.col("l_linestatus") == "F"),
            "rush_attempt": lambda: number(rushing),
            "yards_gained": lambda: F.when(F.col("l_discount") != 0, F.col("l_quantity")),
            "pass_touchdown": lambda: number(F.col("l_discount") >= 0.09),
            "rush_touchdown": lambda: number(F.col("l_discount") >= 0.09),
            "interception": lambda: number(F.col("l_tax") >= 0.08),
            "sack": lambda: number(F.col("l_tax") == 0),
            "qb_dropback": lambda: number(passing),
            "yardline_100": lambda: F.col("p_size").cast("double"),
            "air_yards": lambda: F.when(
                F.col("receiver_player_id").isNotNull(), F.col("l_extendedprice") / 1000),
        }
        return lines.select(*[
            make().alias(name) for name, make in expressions.items() if need(name)])

    @cached_property
    def calendar(self) -> DataFrame:
        """Distinct (season, week)."""
        return self._lines.select("season", "week").distinct()

    @cached_property
    def schedules(self) -> DataFrame:
        n, w, s = F.col("n"), F.col("week"), F.col("season")
        qb = self.raw("supplier").groupBy("s_nationkey").agg(
            _player(F.min("s_suppkey")).alias("qb_id"))
        games = self.calendar.select(
            "season", "week", F.explode(F.sequence(F.lit(0), F.lit(HOME_TEAMS - 1))).alias("n"))
        games = games.withColumn("away", HOME_TEAMS + (n + w) % HOME_TEAMS)
        spread = F.when((n + w) % 17 != 0, ((n * 13 + w * 7 + s) % 29 - 14) / 2)
        favourite = -(spread * 30 + 100)
        underdog = 100 - spread * 30
        games = games.select(
            "season", "week", "n", "away",
            F.date_format(F.make_date("season", "week", 1 + (n * 7 + w) % 28),
                          "yyyy-MM-dd").alias("gameday"),
            spread.alias("spread_line"),
            (35 + (n * 5 + w * 3) % 40 / 2).alias("total_line"),
            F.when(spread > 0, favourite).otherwise(underdog).alias("home_moneyline"),
            F.when(spread > 0, spread * 30 + 100).otherwise(
                spread * 30 - 100).alias("away_moneyline"),
            F.element_at(F.array(*map(F.lit, ["dome", "closed", "open", "outdoors"])),
                         n % 4 + 1).alias("roof"),
            F.when(n % 4 >= 2, 20 + (n * 11 + w * 5) % 70).cast("double").alias("temp"),
            ((n * 3 + w) % 25).cast("double").alias("wind"))
        side = lambda key, name: qb.select(
            F.col("s_nationkey").alias(key), F.col("qb_id").alias(name))
        games = games.join(side("n", "home_qb_id"), "n", "left").join(
            side("away", "away_qb_id"), "away", "left")
        return games.select(
            "season", "week", "gameday", _team(n).alias("home_team"),
            _team(F.col("away")).alias("away_team"), "spread_line", "total_line",
            "home_moneyline", "away_moneyline", "roof", "temp", "wind",
            "home_qb_id", "away_qb_id")

    @cached_property
    def rosters(self) -> DataFrame:
        """One row per supplier and season shipped in."""
        listed = self._lines.select("l_suppkey", "season").distinct().join(
            self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"),
            "l_suppkey", "left")
        pid = _player(F.col("l_suppkey"))
        return listed.select(
            pid.alias("player_id"),
            F.when(F.col("l_suppkey") % 10 != 0,
                   F.concat(F.lit("F"), F.col("l_suppkey").cast("string"))).alias("pfr_id"),
            _position().alias("position"), "season",
            _team(F.col("s_nationkey")).alias("team"),
            F.concat(F.lit("Player "), F.col("l_suppkey").cast("string")).alias("full_name"))

    @cached_property
    def snap_counts(self) -> DataFrame:
        return (self._lines.groupBy("l_suppkey", "season", "week")
                .agg((F.count_if(F.col("l_linestatus") == "F") / F.count(F.lit(1)))
                     .alias("offense_pct"))
                .select(F.concat(F.lit("F"), F.col("l_suppkey").cast("string"))
                        .alias("pfr_player_id"), "season", "week", "offense_pct"))

    @cached_property
    def injuries(self) -> DataFrame:
        """Status by the priority of the player-week's smallest order."""
        first = self._lines.groupBy("l_suppkey", "season", "week").agg(
            F.min("l_orderkey").alias("o_orderkey"))
        reports = first.join(
            self.raw("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "left")
        priority = F.col("o_orderpriority")
        return reports.select(
            _player(F.col("l_suppkey")).alias("gsis_id"), "season", "week",
            F.when(priority == "1-URGENT", "Out").when(priority == "2-HIGH", "Doubtful")
            .otherwise("Questionable").alias("report_status"))

    @cached_property
    def depth_weekly(self) -> DataFrame:
        listed = (self._lines.where(F.col("season") <= LAST_WEEKLY_SEASON)
                  .select("l_suppkey", "season", "week").distinct())
        key, week = F.col("l_suppkey"), F.col("week")
        return listed.select(
            _player(key).alias("gsis_id"), "season", "week",
            F.when(key % 13 == 0, "Defense").otherwise("Offense").alias("formation"),
            _position().alias("position"),
            F.when(key % 11 == 0, "x").otherwise(
                (1 + (key + week) % 3).cast("string")).alias("depth_team"))

    @cached_property
    def depth_snapshots(self) -> DataFrame:
        orders = self.raw("orders").where(
            F.year("o_orderdate") > LAST_WEEKLY_SEASON).select(
            F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        listed = self.raw("lineitem").select("l_orderkey", "l_suppkey").join(
            orders, "l_orderkey")
        return listed.select(
            _player(F.col("l_suppkey")).alias("gsis_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dt"),
            _position().alias("pos_abb"),
            (1 + F.col("l_orderkey") % 3).cast("int").alias("pos_rank"))
