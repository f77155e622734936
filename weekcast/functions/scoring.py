"""Column expressions: scoring, shares, odds, errors, serving conversions.

Every division goes through ``ratio`` so that ANSI mode never raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast import schema


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: Column | str) -> Column:
    """Sum where an all-NULL group is 0 rather than NULL."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 when the condition holds; 0 when it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division where x/0, 0/0 and NULL operands are all 0."""
    return F.coalesce(
        F.try_divide(col(numerator), col(denominator)), F.lit(0.0))


def ppr_points() -> Column:
    # Points per yard, touchdown, interception, reception.
    points = (
        F.col("passing_yards") * 0.04
        + F.col("passing_tds") * 4
        + F.col("interceptions") * -2
        + F.col("rushing_yards") * 0.1
        + F.col("rushing_tds") * 6
        + F.col("receiving_yards") * 0.1
        + F.col("receiving_tds") * 6
        + F.col("receptions") * 1
    )
    return round_even(points, 2)


def round_even(c: Column | str, digits: int) -> Column:
    return F.bround(col(c), digits)


def round_half_up(c: Column | str, digits: int) -> Column:
    return F.round(col(c), digits)


def at_least_zero(c: Column | str) -> Column:
    """Clip below at 0; NULL stays NULL (``greatest`` would skip it)."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(0.0)))


def moneyline_probability(line: Column | str, *, zero_is_underdog: bool = True) -> Column:
    """Implied win probability of an American moneyline, NULL -> 0.5.

    A line of exactly 0 counts as an underdog price in the feature table and
    as a favourite price in slates.
    """
    line = col(line)
    underdog = line >= 0 if zero_is_underdog else line > 0
    stake = F.abs(line) + 100
    return F.when(line.isNull(), schema.DEFAULT_WIN_PROB).when(
        underdog, ratio(F.lit(100.0), stake)
    ).otherwise(ratio(F.abs(line), stake))


def implied_total(total_line: Column | str, team_spread: Column | str) -> Column:
    """Half the total plus half the spread seen from the team (positive = favoured)."""
    return col(total_line) / 2 + col(team_spread) / 2


def is_dome(roof: Column | str = "roof") -> Column:
    return flag(col(roof).isin(schema.INDOOR_ROOFS))


def is_bad_weather(wind: Column | str = "wind", temp: Column | str = "temp",
                   dome: Column | str = "is_dome") -> Column:
    windy = F.coalesce(col(wind) > schema.BAD_WEATHER_WIND, F.lit(False))
    cold = F.coalesce(col(temp) < schema.BAD_WEATHER_TEMP, F.lit(False))
    return flag((windy | cold) & (col(dome) == 0))


def wopr(target_share: Column | str, air_yards_share: Column | str) -> Column:
    return col(target_share) * 1.5 + col(air_yards_share) * 0.7


def adjusted_yards_per_attempt(yards, touchdowns, interceptions, attempts) -> Column:
    return ratio(
        col(yards) + col(touchdowns) * 20 - col(interceptions) * 45, attempts)


def opportunities() -> Column:
    return F.col("rush_attempts") + F.col("targets")


def absolute_error(actual: Column | str, predicted: Column | str) -> Column:
    return F.abs(col(actual) - col(predicted))


def delta(actual: Column | str, projected: Column | str) -> Column:
    """actual - projected; NULL when either is missing."""
    return col(actual) - col(projected)


def trend(projected: Column | str, recent: Column | str) -> Column:
    return F.when(col(projected) >= col(recent), "up").when(
        col(projected) < col(recent), "down")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.date_diff(col(later), col(earlier))


def roster_position(c: Column | str) -> Column:
    """FB counts as RB; anything that is not a skill position is NULL."""
    c = col(c)
    return F.when(c == "FB", "RB").when(c.isin(schema.POSITIONS), c)


def known_position(c: Column | str) -> Column:
    """Positions outside the four known ones are shown as WR."""
    return F.when(col(c).isin(schema.POSITIONS), col(c)).otherwise("WR")


def to_int(c: Column | str) -> Column:
    """Parse an integer; text that is not a number becomes NULL."""
    return F.expr(f"try_cast({c} AS INT)") if isinstance(c, str) else c.try_cast("int")


def instant(text: Column | str) -> Column:
    """Parse an ISO timestamp with a zone to the UTC instant."""
    return F.try_to_timestamp(col(text))


def day(text: Column | str) -> Column:
    return F.to_date(instant(text))


def serving_columns(df: DataFrame) -> list[Column]:
    """NaN -> NULL, decimal -> double, and int for the named integer columns."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in schema.INTEGER_SERVING_COLUMNS:
            whole = F.when(F.isnan(c), None).otherwise(c) if isinstance(
                field.dataType, (T.FloatType, T.DoubleType)) else c
            c = whole.cast("int")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    return out
