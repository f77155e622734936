"""Leakage-safe training frames, time-ordered splits, boosted trees, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, fields, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast import schema
from weekcast.functions import scoring as S
from weekcast.operators import aggregates as A
from weekcast.operators.joins import same_rows
from weekcast.plans import boosting
from weekcast.plans.boosting import Fitted, Job, Params
from weekcast.session import stage
from weekcast.sources.tables import fantasy_weeks

ROW_KEY = ["player_id", "player_name", "season", "week"]
TARGET = schema.TARGET
MIN_TRAIN_ROWS = 50
FILE_ROWS = 524_288                      # of a stored frame, at most
TUNE_WEEKS, TEST_WEEKS = (5, 10), (11, 17)
TRAIN_MAX_WEEK = 10


# --------------------------------------------------------------------------
# Frames
# --------------------------------------------------------------------------

def leakage_guard(df: DataFrame) -> DataFrame:
    """Drop identifiers and everything measured in the game being predicted."""
    return df.drop(*schema.IDENTIFIER_COLUMNS, *schema.SAME_WEEK_OUTCOMES)


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[
        f.name for f in df.schema.fields
        if f.name in keep or isinstance(f.dataType, (T.NumericType, T.BooleanType))])


def one_hot(df: DataFrame, column: str = "position",
            levels: Sequence[str] = tuple(schema.POSITIONS), prefix: str = "pos") -> DataFrame:
    """0/1 columns for fixed levels, none dropped; NULL is all zeros."""
    return df.withColumns({
        f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0))
        for v in levels})


def feature_names() -> list[str]:
    """Columns of the global model, in training order."""
    dropped = {*schema.IDENTIFIER_COLUMNS, *schema.SAME_WEEK_OUTCOMES, TARGET, "position"}
    return [c for c in schema.GOLD_COLUMNS if c not in dropped] + [
        f"pos_{p}" for p in schema.POSITIONS]


def align(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The training features in order: absent ones and NULLs are 0."""
    have = set(df.columns)
    return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0))
            .alias(c) for c in names]


def training_frame(gold: DataFrame, max_week: int = schema.FANTASY_MAX_WEEK) -> DataFrame:
    """Row key, position, target and the global feature set, NULLs as 0."""
    rows = one_hot(fantasy_weeks(gold, max_week))
    names = [c for c in feature_names() if c not in ("season", "week")]
    return rows.select(*ROW_KEY, "recent_team", "position", TARGET, *align(rows, names))


# --------------------------------------------------------------------------
# Splits: a column saying train / val / test, NULL for rows outside
# --------------------------------------------------------------------------

def _split(train: Column, val: Column | None, test: Column) -> Column:
    out = F.when(test, "test")
    if val is not None:
        out = out.when(val, "val")
    return out.when(train, "train")


def static_split(season: int, max_week: int = TRAIN_MAX_WEEK) -> Column:
    s, w = F.col("season"), F.col("week")
    return _split((s < season) | ((s == season) & (w <= max_week)), None,
                  (s == season) & (w > max_week))


def walk_forward_split(season: int, week: int) -> Column:
    """Train up to W-2 plus other seasons, stop early on W-1, predict W."""
    s, w = F.col("season"), F.col("week")
    return _split((s != season) | (w <= week - 2), (s == season) & (w == week - 1),
                  (s == season) & (w == week))


def cold_start_split(season: int) -> Column:
    s, w = F.col("season"), F.col("week")
    val = (s == season - 1) & (w == 1)
    return _split((s < season) & ~val, val, (s == season) & (w == 1))


def slate_split(season: int) -> Column:
    """Everything trains except week 1 of the season before the slate."""
    val = (F.col("season") == season - 1) & (F.col("week") == 1)
    return F.when(val, "val").otherwise("train")


def is_forward_slate(gold: DataFrame, predictions: DataFrame) -> bool:
    """Predictions are ahead of gold, or hold more rows of the same week."""
    def newest(df: DataFrame):
        counts = df.groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.max(F.struct("season", "week", "n")).alias("m")).first()["m"]
        return (row["season"], row["week"]), row["n"]

    (gold_slice, gold_rows) = newest(fantasy_weeks(gold))
    (pred_slice, pred_rows) = newest(predictions)
    return pred_slice > gold_slice or (pred_slice == gold_slice and pred_rows > gold_rows)


# --------------------------------------------------------------------------
# Models
# --------------------------------------------------------------------------

BASELINE = Params(rounds=100, learning_rate=0.1, min_child_weight=1, subsample=1.0,
                  colsample=1.0)
GRID = [Params(max_depth=d, learning_rate=lr, min_child_weight=w)
        for d, lr, w in product([3, 4, 6], [0.03, 0.05], [1, 5])]


def fit(frame: DataFrame, split: Column, features: Sequence[str],
        params: Params = Params()) -> Fitted:
    """Boosted trees on the rows that ``split`` marks 'train'; where it marks 'val' rows,
    the rounds up to the early stop."""
    return boosting.fit_many(frame, [Job("one", params, split, tuple(features))], TARGET)["one"]


def stored_frame(frame: DataFrame) -> DataFrame:
    """The frame written once, since cut points, blocks and predictions each scan it: in one
    file, or, beyond a part's rows, in files enough for all cores."""
    rows = frame.count()
    if rows <= boosting.PAIRED_ROWS:
        return stage(frame.hint("rebalance"), "frame")
    cores = frame.sparkSession.sparkContext.defaultParallelism
    files = max(-(-rows // FILE_ROWS), min(2 * cores, -(-rows // boosting.PAIRED_ROWS)))
    return stage(frame.repartition(files), "frame")


def _folds(frame: DataFrame, weeks: tuple[int, int | None], by: Column) -> dict[str, list[int]]:
    """The test weeks of each group that have enough rows to learn from, and the season;
    one small count per (group, season, week)."""
    sizes = {(r["by"], r["season"], r["week"]): r["n"] for r in frame.groupBy(
        by.alias("by"), "season", "week").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds: dict[str, list[int]] = {}
    season = max(s for _, s, _ in sizes)
    last = max(w for _, s, w in sizes if s == season) if weeks[1] is None else weeks[1]
    for group in {g for g, *_ in sizes}:
        for w in range(weeks[0], last + 1):
            train_rows = sum(n for (g, s, k), n in sizes.items()
                             if g == group and (s != season or k <= w - 2))
            if ((group, season, w) in sizes and (group, season, w - 1) in sizes
                    and train_rows >= MIN_TRAIN_ROWS):
                folds.setdefault(group, []).append(w)
    if not folds:
        raise ValueError("no test week has a training, validation and test part")
    return {"season": season, **folds}


def walk_models(frame: DataFrame, settings: dict[str, Params], weeks: tuple[int, int | None],
                groups: dict[str, Sequence[str]] | None = None) -> dict[tuple, list]:
    """(group, season, week) -> [(setting, model)] for every fold, all fitted together.

    ``groups`` gives each position its own rows and features; without it there is one
    group '' of all rows and the global features.
    """
    apart = groups is not None
    groups = groups or {"": feature_names()}
    folds = _folds(frame, weeks, F.col("position") if apart else F.lit(""))
    season = folds.pop("season")
    jobs, of = [], {}
    for group, week, setting in ((g, w, s) for g in folds if g in groups for w in folds[g]
                                 for s in settings):
        split = walk_forward_split(season, week)
        if apart:
            split = F.when(F.col("position") == group, split)
        name = f"{group}|{week}|{setting}"
        of[name] = (group, season, week), setting
        jobs.append(Job(name, settings[setting], split, tuple(groups[group])))
    models: dict[tuple, list] = {}
    for name, fitted in boosting.fit_many(frame, jobs, TARGET).items():
        key, setting = of[name]
        models.setdefault(key, []).append((setting, fitted))
    return models


def walk_results(frame: DataFrame, models: dict[tuple, list]) -> DataFrame:
    """Every fold's model on its own test week."""
    apart = all(group for group, *_ in models)
    rows = frame.withColumn("by", F.col("position") if apart else F.lit(""))
    scored = boosting.predict_each(rows, ["by", "season", "week"], models,
                                   [*ROW_KEY, "position", TARGET])
    return scored.select("setting", *ROW_KEY, "position", F.col(TARGET).alias("actual"),
                         F.col("prediction").alias("predicted"),
                         F.col("week").alias("test_week"), "best_iteration")


def walk_forward(frame: DataFrame, params: Params = Params(),
                 weeks: tuple[int, int | None] = TEST_WEEKS) -> DataFrame:
    """Out-of-sample predictions of every test week of the latest season.

    ``weeks`` are the first and the last test week; None as the last one means the
    last week that the season has.
    """
    frame = stored_frame(frame)
    return walk_results(frame, walk_models(frame, {"": params}, weeks)).drop("setting")


def per_position(frame: DataFrame, params: Params = Params(),
                 weeks: tuple[int, int | None] = TEST_WEEKS) -> DataFrame:
    """One model per position on its own rows and feature group."""
    frame = stored_frame(frame)
    models = walk_models(frame, {"": params}, weeks, position_features())
    return walk_results(frame, models).drop("setting")


def position_features() -> dict[str, list[str]]:
    return {p: schema.SHARED_FEATURES + extra for p, extra in schema.POSITION_FEATURES.items()}


def tune(frame: DataFrame, grid: Sequence[Params] = tuple(GRID),
         weeks: tuple[int, int | None] = TUNE_WEEKS) -> DataFrame:
    """Walk-forward MAE of each setting on the tuning weeks, best first; all settings and
    folds are fitted together."""
    frame = stored_frame(frame)
    models = walk_models(frame, {str(i): p for i, p in enumerate(grid)}, weeks)
    return tuned(walk_results(frame, models), grid)


def tuned(results: DataFrame, grid: Sequence[Params]) -> DataFrame:
    measured = A.mean_absolute_error(results, "actual", "predicted", "setting")
    settings = results.sparkSession.createDataFrame(
        [{"setting": str(i), **asdict(p)} for i, p in enumerate(grid)])
    keys = [f.name for f in fields(Params)]
    return settings.join(measured, "setting").select(
        *keys, S.round_even("mae", 3).alias("tune_mae")).orderBy("tune_mae", *keys)


def best_params(tuning: DataFrame) -> Params:
    row = tuning.limit(1).first().asDict()
    row.pop("tune_mae")
    return replace(Params(), **row)


def latest_model(gold: DataFrame, params: Params = Params()) -> tuple[Fitted, DataFrame]:
    """The model that projects the newest week, and that week's frame."""
    newest = A.latest_slice(fantasy_weeks(gold).select("season", "week")).first()
    frame, split = stored_frame(training_frame(gold)), walk_forward_split(*newest)
    return fit(frame, split, feature_names(), params), frame.where(split == "test")


def predict_latest(gold: DataFrame, params: Params = Params()) -> DataFrame:
    """Project the newest completed week from everything known before it."""
    fitted, test = latest_model(gold, params)
    rows = fantasy_weeks(gold)
    newest = A.latest_slice(rows.select("season", "week")).first()
    week = rows.where((F.col("season") == F.lit(newest["season"]))
                      & (F.col("week") == F.lit(newest["week"])))
    return prediction_rows(week, fitted.predict(test).select(*ROW_KEY, "prediction"))


def prediction_rows(week: DataFrame, scored: DataFrame) -> DataFrame:
    """Ids, projection, actual (1 decimal) and context (2 decimals).

    ``scored`` is matched on the row key, never on row order.
    """
    context = [S.round_even(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2).alias(c)
               for c in schema.PREDICTION_CONTEXT]
    return same_rows(week, scored, ROW_KEY).select(
        "player_id", "player_name", "recent_team", "position", "season", "week", "opponent",
        S.round_even(S.at_least_zero("prediction"), 1).alias("projected_ppr"),
        S.round_even(TARGET, 1).alias("actual_ppr"), *context)


# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------

def mae_by_position(results: DataFrame, digits: int = 2) -> DataFrame:
    """MAE and row count in the order QB, RB, WR, TE; absent positions are NULL."""
    measured = A.mean_absolute_error(results, "actual", "predicted", "position")
    pairs = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(i).alias("ordinal"))
                      for i, p in enumerate(schema.POSITIONS)])
    levels = results.sparkSession.range(1).select(F.inline(pairs))
    return levels.join(measured, "position", "left").orderBy("ordinal").select(
        "position", S.round_even("mae", digits).alias("mae"), "n")


def naive_form(rows: DataFrame) -> DataFrame:
    """Predict the shifted 3-week average."""
    return _naive(rows, F.col("fantasy_points_3wk_avg"))


def naive_previous_season(rows: DataFrame) -> DataFrame:
    return _naive(rows, F.greatest(F.col("prev_season_ppg"), F.lit(0.0)))


def naive_training_mean(test: DataFrame, train: DataFrame) -> DataFrame:
    """Predict the mean of the training target."""
    return _naive(test, train.agg(F.avg(TARGET)).scalar())


def _naive(rows: DataFrame, predicted: Column) -> DataFrame:
    return rows.select(*ROW_KEY, "position", F.col(TARGET).alias("actual"),
                       predicted.alias("predicted"), F.col("week").alias("test_week"))


def compare(models: dict[str, DataFrame], digits: int = 2) -> DataFrame:
    """MAE per position and overall, one column per model, on the rows that
    every model predicted."""
    names = list(models)
    common = None
    for name, results in models.items():
        part = results.select(*ROW_KEY, *(["position", "actual"] if common is None else []),
                              F.col("predicted").alias(name))
        common = part if common is None else same_rows(common, part, ROW_KEY)
    errors = [F.avg(S.absolute_error("actual", n)).alias(n) for n in names]
    by_position = common.groupBy("position").agg(*errors)
    overall = common.agg(*errors).withColumn("position", F.lit("OVERALL"))
    return by_position.unionByName(overall).select(
        "position", *[S.round_even(n, digits).alias(n) for n in names])


def mae_by_week(models: dict[str, DataFrame]) -> DataFrame:
    """MAE per test week, one column per model."""
    tagged = None
    for name, results in models.items():
        part = results.select("test_week", S.absolute_error("actual", "predicted").alias("e"),
                              F.lit(name).alias("model"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("test_week").agg(*[
        F.avg(F.when(F.col("model") == n, F.col("e"))).alias(n) for n in models])


def mean_best_iteration(results: DataFrame) -> DataFrame:
    """Mean early-stopping round over the folds."""
    folds = results.groupBy("test_week").agg(F.max("best_iteration").alias("best"))
    return folds.agg(F.avg("best").alias("mean_best_iteration"))


def biggest_misses(results: DataFrame, k: int = 5) -> DataFrame:
    """The k largest over- and under-projections by signed miss."""
    missed = results.withColumn("miss", F.col("predicted") - F.col("actual"))
    over = missed.orderBy(F.desc("miss"), *ROW_KEY).limit(k)
    under = missed.orderBy(F.asc("miss"), *ROW_KEY).limit(k)
    return over.withColumn("direction", F.lit("over")).unionByName(
        under.withColumn("direction", F.lit("under")))


def best_actuals(results: DataFrame, k: int = 10) -> DataFrame:
    return results.withColumn("abs_error", S.absolute_error("actual", "predicted")).orderBy(
        F.desc("actual"), *ROW_KEY).limit(k)
