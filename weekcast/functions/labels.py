"""Text expressions: matchup and venue labels, search, insight sentences."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# The wording of labels, insights and requests
# --------------------------------------------------------------------------

HOME, AWAY = "vs", "@"
DOME, BAD_WEATHER, OUTDOOR = "Dome", "Bad weather", "Outdoor"
DOME_NOTE, WEATHER_NOTE = "dome", "weather"
WIN_PROB_RISK = 0.4

PROJECTION = "{player_name} projects for {projected_ppr} PPR points against {opponent}."
SCRIPT = "Vegas implies a {total}-point team total in a {lean} game script, {form}"
FAVORABLE, TOUGH = "favorable", "tough"
WITH_FORM = "and he has averaged {form} points over the last three weeks."
WITHOUT_FORM = "with no in-season form yet (week 1)."
WEATHER_RISK = "Bad weather is a downside risk for this game."
DEFENSE_RISK = ("Risk: {opponent} has been stingy against {position}s "
                "({allowed} PPR pts/game allowed).")
HISTORY_RISK = "Risk: no prior-season scoring history (rookie or unranked)."
STINGY_BELOW = 15

INSTRUCTIONS = """\
You are a fantasy football analyst. Using ONLY the data below, write a 2-3 sentence
insight for this player's upcoming game. Mention the projection, one supporting factor,
and one risk factor. Do not invent injuries or news not present in the data.
If recent form or opponent defense is listed as not available, do not treat it as zero skill.
"""
PLAYER_LINE = "Player: {player_name} ({position}, {recent_team})"
OPPONENT_LINE = "Opponent: {opponent} ({venue})"
AT_HOME, ON_THE_ROAD = "at home", "on the road"
PROJECTION_LINE = "Model projection: {projected_ppr} PPR points"
FORM_LINE = "Recent form (3-week avg): {form} PPR points"
NO_FORM_LINE = "Recent form (3-week avg): not available yet (no games played this season)"
HISTORY_LINE = "Previous season average: {ppg} PPR points"
VEGAS_LINE = "Vegas implied team total: {total} | spread: {spread} | win prob: {win}%"
DEFENSE_LINE = "Opponent defense allows {allowed} PPR points/game to {position}s"
NO_DEFENSE_LINE = ("Opponent {position} defense allowed: not available yet "
                   "(preseason / week 1)")
DEPTH_LINE = "Depth chart rank: {depth}"
WEATHER_LINE = "Weather: {weather}"
INDOORS = "indoors (dome)"
CONDITIONS = "{temp}F, {wind} mph wind{note}"
BAD_NOTE = " — bad weather game"
DEFAULT_DEPTH = 9.0


# --------------------------------------------------------------------------
# Helpers
# --------------------------------------------------------------------------

def sentence(template: str, **columns: Column) -> Column:
    """Fill a template with columns; a field not given is the column itself."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(columns.get(field, _text(field)))
    return F.concat(*parts)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def _truthy(name: str) -> Column:
    return _number(name) != 0


def _fixed(c: Column, pattern: str) -> Column:
    """Format a double by pattern, ties to even on its exact binary value."""
    return F.call_function("format_number", c, F.lit(pattern))


def _one_decimal(c: Column) -> Column:
    return _fixed(c, "0.0")


# --------------------------------------------------------------------------
# Labels
# --------------------------------------------------------------------------

def matchup(is_home: str = "is_home", opponent: str = "opponent") -> Column:
    return F.concat_ws(" ", F.when(_truthy(is_home), HOME).otherwise(AWAY), F.col(opponent))


def venue() -> Column:
    return F.when(_truthy("is_dome"), DOME).when(
        _truthy("is_bad_weather"), BAD_WEATHER).otherwise(OUTDOOR)


def venue_note() -> Column:
    return F.when(_truthy("is_dome"), DOME_NOTE).when(_truthy("is_bad_weather"), WEATHER_NOTE)


def risk_flags() -> list[Column]:
    """Spread, win-probability and weather cells marked as risks."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [
        yes(F.col("team_spread") > 0).alias("spread_risk"),
        yes(F.col("team_win_prob") < WIN_PROB_RISK).alias("win_prob_risk"),
        yes(_truthy("is_bad_weather")).alias("weather_risk"),
    ]


def has_text(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))


def name_contains(query: str, name: str = "player_name") -> Column:
    """Case-insensitive substring match; a blank query matches nothing."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(False)
    return F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))


# --------------------------------------------------------------------------
# Insight text
# --------------------------------------------------------------------------

def template_insight() -> Column:
    """Two or three sentences built from the columns of a predictions row."""
    form, allowed = _number("fantasy_points_3wk_avg"), _number("opp_def_ppg_allowed")
    script = sentence(
        SCRIPT, total=_one_decimal(_number("implied_total")),
        lean=F.when(_number("team_spread") > 0, FAVORABLE).otherwise(TOUGH),
        form=F.when(form != 0, sentence(WITH_FORM, form=_one_decimal(form)))
        .otherwise(WITHOUT_FORM))
    risk = F.when(_truthy("is_bad_weather"), WEATHER_RISK).when(
        (allowed != 0) & (allowed < STINGY_BELOW),
        sentence(DEFENSE_RISK, allowed=_one_decimal(allowed))).when(
        _number("prev_season_ppg") == 0, HISTORY_RISK)
    return F.concat_ws(" ", sentence(PROJECTION), script, risk)


def prompt() -> Column:
    """The request text for an external generator, one per predictions row."""
    form, allowed = _number("fantasy_points_3wk_avg"), _number("opp_def_ppg_allowed")
    plain = lambda name: _number(name).cast("string")
    outdoors = sentence(
        CONDITIONS, temp=_fixed(_number("temp"), "0"), wind=_fixed(_number("wind"), "0"),
        note=F.when(_truthy("is_bad_weather"), BAD_NOTE).otherwise(""))
    return F.concat_ws(
        "\n", F.lit(INSTRUCTIONS), sentence(PLAYER_LINE),
        sentence(OPPONENT_LINE,
                 venue=F.when(_truthy("is_home"), AT_HOME).otherwise(ON_THE_ROAD)),
        sentence(PROJECTION_LINE),
        F.when(form != 0, sentence(FORM_LINE, form=form.cast("string"))).otherwise(NO_FORM_LINE),
        sentence(HISTORY_LINE, ppg=plain("prev_season_ppg")),
        sentence(VEGAS_LINE, total=plain("implied_total"),
                 spread=_fixed(_number("team_spread"), "+0.0;-0.0"),
                 win=_fixed(_number("team_win_prob") * 100, "0")),
        F.when(allowed != 0, sentence(DEFENSE_LINE, allowed=allowed.cast("string")))
        .otherwise(sentence(NO_DEFENSE_LINE)),
        sentence(DEPTH_LINE, depth=_number("depth_chart_rank", DEFAULT_DEPTH)
                 .cast("int").cast("string")),
        sentence(WEATHER_LINE, weather=F.when(_truthy("is_dome"), INDOORS).otherwise(outdoors)))
