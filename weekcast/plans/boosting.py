"""Boosted regression trees, many fits in step, with the early stop inside the loop.

The frame is binned once and packed into blocks of rows. A round adds a tree to every fit
that has not stopped: for each level, gradient histograms of all fits are summed over the
blocks. The first sums of a round also measure the last round's validation error, so a fit
ends in the round in which its patience runs out, and its trees are a model as they are.

Frames of more than ``PAIRED_ROWS`` rows are summed in whole numbers: gradients are rounded
to multiples of a power of two so small that sums over all rows are exact. So neither the
order of rows nor their division into blocks matters, of two children only that with fewer
rows is summed (the other one is the rest of its parent), and two features at a time are
summed by pairs of bins.

Trees follow the published second-order rules for squared error: a leaf is worth
-G / (H + 1), a split gains what it adds to G^2 / (H + 1), and a child needs
``min_child_weight`` rows. Rows and columns are sampled once a tree.

A fitted model is a short table of nodes. Scores are worked out from it by arrays
(``Fitted.predict``) or by joins down the levels (``score_by_joins``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.session import stage

BINS = 64
SHRINK = 1.0                  # added to the weight of every leaf
BLOCK_ROWS = 16_384
WHOLE_ROWS = 3_145_728        # a frame, or the rows of a fit, up to this size is one block of one
                              # task, which needs some 200 bytes a row
PAIRED_ROWS = 16_384          # frames of more rows are summed exactly, by pairs of features
EXACT_BITS = 50               # of sums of gradients, in whole numbers
IN_STEP = 12                  # fits of one group; bounds what a job sends
REFRESH = 10                  # rounds between stored scores
TRAIN, VAL = 1, 2
NODE_COLUMNS = ("tree int, node int, feature int, threshold double, left int, right int, "
                "value double, gain double, rows double")


@dataclass(frozen=True)
class Params:
    """Boosting settings; ``min_child_weight`` counts rows, as each has weight 1."""

    rounds: int = 500
    learning_rate: float = 0.05
    max_depth: int = 4
    min_child_weight: int = 5
    subsample: float = 0.8
    colsample: float = 0.8
    patience: int = 20
    seed: int = 42


@dataclass(frozen=True)
class Job:
    """One fit: its settings, the rows it learns from ('train', 'val', else unused) and
    the features it may split on."""

    name: str
    params: Params
    split: Column
    features: tuple[str, ...]


class Tree:
    """Nodes in heap order: the children of i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.bin = np.full(n, -1), np.zeros(n, dtype=np.int64)
        self.threshold, self.value = np.zeros(n), np.zeros(n)
        self.gain, self.rows = np.zeros(n), np.zeros(n)

    def walk(self, columns: np.ndarray, cuts: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node each row ends in. A row of ``columns`` holds a feature; ``cuts`` are bins
        for binned features, else thresholds. Each split is one comparison of a whole column."""
        number = np.min_scalar_type(len(self.feature))

        def below(i: int, levels: int) -> np.ndarray:
            if not levels or self.feature[i] < 0:
                return number.type(i)
            low, high = below(2 * i + 1, levels - 1), below(2 * i + 2, levels - 1)
            right = columns[self.feature[i]] > cuts[i].item()
            return low ^ ((low ^ high) & -right.astype(number))

        node = below(0, self.depth if levels is None else levels)
        return np.broadcast_to(node, columns.shape[1:])


@dataclass(frozen=True)
class Fitted:
    features: list[str]           # all that rows are read with, in order
    base: float
    trees: list[Tree]
    best_iteration: int
    errors: list[float]           # validation error after each round

    def score(self, x: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        for t in self.trees:
            out += t.value[t.walk(columns, t.threshold)]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the column prediction."""
        width = len(self.features)

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False)
            return pa.array(self.score(values.reshape(-1, width)))

        return df.withColumn("prediction", predicted(_vector(self.features)))

    def nodes(self) -> list[tuple]:
        """The model as rows of ``NODE_COLUMNS``; ``left`` and ``right`` are null in leaves."""
        rows = []
        for k, t in enumerate(self.trees):
            reached = {0}
            for i in range(len(t.feature)):
                if i in reached:
                    inner = t.feature[i] >= 0
                    left, right = (2 * i + 1, 2 * i + 2) if inner else (None, None)
                    reached |= {left, right}
                    rows.append((k, i, int(t.feature[i]), float(t.threshold[i]), left, right,
                                 float(t.value[i]), float(t.gain[i]), float(t.rows[i])))
        return rows

    def gains(self) -> list[float]:
        """Each feature's mean gain over its splits, as a share of all features' means."""
        total, splits = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(splits, t.feature[inner], 1)
        mean = total / np.maximum(splits, 1)
        return (mean / max(mean.sum(), 1e-300)).tolist()

    def importance(self, spark: SparkSession, k: int = 10) -> DataFrame:
        """Top-k features by importance (one row a feature on the driver)."""
        rows = spark.createDataFrame(list(zip(self.features, self.gains())),
                                     "feature string, importance double")
        return rows.orderBy(F.desc("importance"), "feature").limit(k)


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def predict_each(df: DataFrame, by: Sequence[str], models: dict[tuple, list[tuple[str, Fitted]]],
                 keep: Sequence[str]) -> DataFrame:
    """Each row scored by every model of its key: ``keep``, setting, prediction, best_iteration.

    ``models`` maps values of ``by`` to (setting, model) pairs; rows of other keys are left
    out. Models fitted together read the same features.
    """
    features = next(m for found in models.values() for _, m in found).features
    fields = [*keep, *[c for c in by if c not in keep]]
    rows = df.select(*fields, _vector(features).alias("x"))
    kept = [f for f in rows.schema.fields if f.name in keep]
    out = T.StructType([*kept, T.StructField("setting", T.StringType()),
                        T.StructField("prediction", T.DoubleType()),
                        T.StructField("best_iteration", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, len(features))
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                if key in models:
                    rows_of.setdefault(key, []).append(i)
            for key, mine in rows_of.items():
                part = batch.take(pa.array(mine))
                for setting, model in models[key]:
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(f.name) for f in kept]
                        + [pa.array([setting] * n, pa.string()), pa.array(model.score(x[mine])),
                           pa.array([model.best_iteration] * n, pa.int32())], names=out.names)

    return rows.mapInArrow(run, out)


def node_table(spark: SparkSession, models: dict[str, Fitted]) -> DataFrame:
    """All nodes of all models, with the model's name and base."""
    rows = [(name, m.base, *node) for name, m in models.items() for node in m.nodes()]
    return spark.createDataFrame(rows, f"model string, base double, {NODE_COLUMNS}")


def score_by_joins(df: DataFrame, key: Sequence[str], model: Column, models: dict[str, Fitted]) -> DataFrame:
    """Key and prediction of the model that ``model`` names, by joining (row, tree) pairs to
    the node table level by level. The key must tell rows apart.

    The node table is stored, so Spark broadcasts it if its size allows.
    """
    features = next(iter(models.values())).features
    nodes = stage(node_table(df.sparkSession, models), "nodes")
    at = df.select(*key, _vector(features).alias("x"), model.alias("model")).join(
        nodes.where("node = 0").select("model", "base", "tree", "node"), "model")
    steps = nodes.drop("base", "gain", "rows")
    for _ in range(max(t.depth for m in models.values() for t in m.trees)):
        here = at.join(steps, ["model", "tree", "node"])
        value = F.get("x", F.greatest("feature", F.lit(0)))
        at = here.select(*at.columns[:-1], F.when(F.col("left").isNull(), F.col("node")).when(
            value <= F.col("threshold"), F.col("left")).otherwise(F.col("right")).alias("node"))
    return at.join(steps, ["model", "tree", "node"]).groupBy(*key).agg(
        (F.first("base") + F.sum("value")).alias("prediction"))


def gains_by_nodes(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Importance of every feature, worked out from the node table."""
    nodes = node_table(spark, {"": fitted}).where("feature >= 0").groupBy("feature").agg(
        F.avg("gain").alias("mean"))
    names = spark.createDataFrame(list(enumerate(fitted.features)), "feature int, name string")
    total = nodes.agg(F.sum("mean")).scalar()
    return names.join(nodes, "feature", "left").select(
        F.col("name").alias("feature"),
        F.coalesce(F.col("mean") / total, F.lit(0.0)).alias("importance"))


# --------------------------------------------------------------------------
# Binned blocks
# --------------------------------------------------------------------------

def cut_points(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Up to ``BINS`` - 1 values of each feature that splits may lie at."""
    steps = ", ".join(f"{i / BINS}D" for i in range(1, BINS))       # as text: one call each
    found = rows.agg(*[F.expr(f"percentile_approx(coalesce(CAST(`{c}` AS DOUBLE), 0D), "
                              f"array({steps}), 10000)").alias(f"q{i}")
                       for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in found]


def packed_blocks(frame: DataFrame, features: Sequence[str], target: str,
                  splits: Sequence[Column], cuts: Sequence[np.ndarray],
                  block_rows: int = BLOCK_ROWS, whole_rows: int = WHOLE_ROWS) -> RDD:
    """(parts, bins, target, split codes) of blocks, kept in memory and, where that is short,
    on disk; a lost block is read again from the stored table. Bins lie by feature. Parts are
    (number, rows) of up to ``block_rows`` rows, which are sampled apart. A frame of up to
    ``whole_rows`` rows is one block of all parts; the parts of a larger one are dealt to
    blocks of about as many rows, or to one for each core."""
    code = lambda s: F.when(s == "train", TRAIN).when(s == "val", VAL).otherwise(0)
    rows = frame.select(_vector(features).alias("x"), F.col(target).cast("double").alias("y"),
                        F.array(*map(code, splits)).alias("s")).where("y IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, block_rows):
                batch = whole.slice(lo, block_rows)
                n = batch.num_rows
                x = batch.column("x").flatten().to_numpy().reshape(n, -1)
                bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
                s = batch.column("s").flatten().to_numpy().reshape(n, -1)
                body = pickle.dumps((bins.astype(np.uint8), batch.column("y").to_numpy(),
                                     s.astype(np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([body], pa.binary()), pa.array([n], pa.int64())], ["body", "n"])

    stored = stage(rows.mapInArrow(pack, "body binary, n long"), "blocks")
    parts, total = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = stored.rdd.map(lambda r: pickle.loads(r.body)).zipWithIndex().map(
        lambda b: (((b[1], len(b[0][1])),), *b[0]))
    if total <= whole_rows:
        blocks = blocks.coalesce(1)
    else:
        least = -(-total // (whole_rows or block_rows))
        count = min(parts, max(least, blocks.context.defaultParallelism))
        blocks = blocks.map(lambda b: (b[0][0][0], b)).partitionBy(count, int).values()
    return blocks.mapPartitions(_as_one).persist(StorageLevel.MEMORY_AND_DISK)


def _as_one(blocks: Iterable[tuple]) -> Iterator[tuple]:
    """One block of all."""
    parts = list(zip(*blocks))
    if parts:
        numbers, bins, y, splits = parts
        yield (tuple(p for n in numbers for p in n), np.concatenate(bins, axis=1),
               np.concatenate(y), np.concatenate(splits))


# --------------------------------------------------------------------------
# Growing
# --------------------------------------------------------------------------

@dataclass
class Fit:
    """One fit while it grows. What a level of a tree is sent has only the trees that stored
    scores do not hold, and the number ``before`` of the others."""

    params: Params
    split: int                    # which split codes
    use: np.ndarray               # features it may split on
    base: float = 0.0
    scale: float = 1.0            # gradients times this are rounded to whole numbers
    watched: bool = False         # it has validation rows
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    open: bool = True
    before: int = 0

    @property
    def grown(self) -> int:
        return self.before + len(self.trees)

    def columns(self) -> np.ndarray:
        """The features of the next tree."""
        if self.params.colsample >= 1:
            return self.use
        mine = np.flatnonzero(self.use)
        drawn = np.random.default_rng([self.params.seed, self.grown]).permutation(mine)
        out = np.zeros_like(self.use)
        out[drawn[:max(1, round(self.params.colsample * len(mine)))]] = True
        return out

    def summed(self) -> np.ndarray:
        """The numbers of the features to sum: those of the next tree, and the first one, which
        a node's whole sums are taken from."""
        return np.flatnonzero(self.columns() | (np.arange(len(self.use)) == 0))

    def drawn(self, parts: Sequence[tuple[int, int]]) -> np.ndarray:
        """Which rows of these parts the next tree may learn from."""
        return np.concatenate([
            np.random.default_rng([self.params.seed, self.grown, number]).random(n)
            for number, n in parts]) < self.params.subsample

    def measured(self, error: float) -> None:
        """Note the error of the trees so far; stop where the patience or the rounds end."""
        self.errors.append(error)
        late = len(self.errors) - 1 - int(np.argmin(self.errors)) >= self.params.patience
        self.open = not late and len(self.trees) < self.params.rounds


def _sums(block, fits: dict[int, Fit], growing: dict[int, Tree], level: int,
          score_of: Callable[[int], np.ndarray]) -> Iterator[tuple[tuple[int, str], np.ndarray]]:
    """Of one block: gradients and rows by (node of the level, feature, bin) of the features
    that the tree needs, and before the first level each fit's validation error."""
    parts, columns, y, splits = block
    for k, tree in growing.items():
        fit = fits[k]
        off = score_of(k) - y
        if level == 0:
            held = off[splits[:, fit.split] == VAL]
            yield (k, "val"), np.array([held @ held, len(held)])
        part = splits[:, fit.split] == TRAIN
        if fit.params.subsample < 1:
            part &= fit.drawn(parts)
        first = 2 ** level - 1
        node = tree.walk(columns, tree.bin, level)
        rows = np.flatnonzero(part & (node >= first))
        cell, off = (node[rows].astype(np.int64) - first) * BINS, off[rows]
        features, size = fit.summed(), 2 ** level * BINS
        sums = np.empty((2, 2 ** level, len(features), BINS))
        for j, f in enumerate(features):
            at = cell + columns[f].take(rows)
            sums[0, :, j] = np.bincount(at, off, size).reshape(-1, BINS)
            sums[1, :, j] = np.bincount(at, minlength=size).reshape(-1, BINS)
        yield (k, "grow"), sums


def best_splits(sums: np.ndarray, allowed: np.ndarray, least: int) -> list[tuple]:
    """For each node: feature (-1: leaf), bin, gain, the left (G, H) and the whole (G, H)."""
    g, h = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
    worth = lambda a, b: a * a / (b + SHRINK)
    out = []
    for n in range(g.shape[0]):
        whole_g, whole_h = float(g[n, 0, -1]), float(h[n, 0, -1])
        gain = worth(g[n], h[n]) + worth(whole_g - g[n], whole_h - h[n]) - worth(whole_g, whole_h)
        gain[(h[n] < least) | (whole_h - h[n] < least) | ~allowed[:, None]] = -np.inf
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        split = int(f), int(b), float(gain[f, b]), float(g[n, f, b]), float(h[n, f, b])
        out.append((*(split if gain[f, b] > 1e-9 else (-1, 0, 0.0, 0.0, 0.0)), whole_g, whole_h))
    return out


def _finished(key: tuple[int, str], sums: np.ndarray, fits: dict[int, Fit]):
    """Histograms become splits where they have been summed; errors stay sums."""
    k, what = key
    if what == "grow":
        features = fits[k].summed()
        found = best_splits(sums, fits[k].columns()[features], fits[k].params.min_child_weight)
        return key, [(int(features[f]) if f >= 0 else f, *rest) for f, *rest in found]
    return key, sums


def _round(fits: dict[int, Fit], summed: Callable, cuts: Sequence[np.ndarray]) -> None:
    """One tree for every open fit. ``summed(growing, level)`` gives the splits of a level
    and, with the first, the validation errors of the trees before this round."""
    growing = {k: Tree(f.params.max_depth) for k, f in fits.items() if f.open}
    for level in range(max(fits[k].params.max_depth for k in growing)):
        found = summed({k: t for k, t in growing.items() if level < t.depth}, level)
        for (k, what), sums in found.items():
            if what == "val" and fits[k].watched and fits[k].trees:
                fits[k].measured(float(sums[0] / sums[1]))
        growing = {k: t for k, t in growing.items() if fits[k].open}
        for k, tree in growing.items():
            if level < tree.depth:
                _place(tree, found[k, "grow"], level, fits[k].params.learning_rate, cuts)
        if not growing:
            return
    for k, tree in growing.items():
        fits[k].trees.append(tree)
        if not fits[k].watched:
            fits[k].open = len(fits[k].trees) < fits[k].params.rounds


def _place(tree: Tree, found: list, level: int, rate: float, cuts: Sequence[np.ndarray]) -> None:
    """Put the splits of a level into the tree, and the values of the nodes below."""
    for i, (f, b, gain, left_g, left_h, g, h) in enumerate(found, 2 ** level - 1):
        if level == 0:
            tree.value[i], tree.rows[i] = -rate * g / (h + SHRINK), h
        elif tree.feature[(i - 1) // 2] < 0:
            continue
        if f >= 0 and b < len(cuts[f]):
            tree.feature[i], tree.bin[i], tree.gain[i] = f, b, gain
            tree.threshold[i] = cuts[f][b]
            for child, cg, ch in ((2 * i + 1, left_g, left_h), (2 * i + 2, g - left_g, h - left_h)):
                tree.value[child], tree.rows[child] = -rate * cg / (ch + SHRINK), ch


def _scores(block, fits: Iterable[Fit]) -> np.ndarray:
    """Scores of all trees of each fit, a row a fit."""
    return np.stack([sum((t.value[t.walk(block[1], t.bin)] for t in f.trees),
                         np.full(len(block[2]), f.base)) for f in fits])


def _means(block, fits: Iterable[Fit]) -> np.ndarray:
    """Of one block, a row a fit: the targets of the training rows in sum, their number, that
    of the validation rows, and the sum of the squared targets."""
    _, _, y, splits = block
    learnt = [y[splits[:, f.split] == TRAIN] for f in fits]
    return np.array([[t.sum(), len(t), (splits[:, f.split] == VAL).sum(), t @ t]
                     for f, t in zip(fits, learnt)])


def _begun(fits: Iterable[Fit], means: np.ndarray) -> None:
    """Gradients begin as the targets less their mean and shrink, so the root of rows times
    squared targets bounds what any sum of them comes to."""
    for f, (total, n, held, squares) in zip(fits, means, strict=True):
        f.base, f.watched = float(total / max(n, 1)), bool(held)
        f.scale = 2.0 ** (EXACT_BITS - int(np.ceil(np.log2(max(np.sqrt(n * squares), 1.0)))))


def _grown_in_block(block, fit: Fit, cuts: Sequence[np.ndarray]) -> Fit:
    """All rounds of a fit over a frame of one block: all sums are complete in its task, and
    each tree is walked once."""
    fits = {0: fit}
    _begun([fit], _means(block, [fit]))
    scores = _scores(block, [fit])[0]
    while fit.open:
        before = len(fit.trees)
        _round(fits, lambda growing, level: dict(
            _finished(key, sums, fits) for key, sums in _sums(
                block, fits, growing, level, lambda _: scores)), cuts)
        for t in fit.trees[before:]:
            scores = scores + t.value[t.walk(block[1], t.bin)]
    return fit


def _node_sums(columns: np.ndarray, rows: np.ndarray, grads: np.ndarray,
               features: np.ndarray) -> np.ndarray:
    """Gradients and numbers of these rows by (feature, bin). A count over the pairs of bins
    of two features has both their sums; it pays where rows outnumber the pairs."""
    out, mine, j = np.empty((2, len(features), BINS)), grads.take(rows), 0
    while j < len(features):
        at = columns[features[j]].take(rows).astype(np.int64)
        if j + 1 < len(features) and len(rows) > BINS ** 2:
            at <<= BINS.bit_length() - 1
            at |= columns[features[j + 1]].take(rows)
            for k, weights in enumerate((mine, None)):
                both = np.bincount(at, weights, BINS ** 2).reshape(BINS, BINS)
                out[k, j], out[k, j + 1] = both.sum(axis=1), both.sum(axis=0)
            j += 2
        else:
            out[0, j], out[1, j] = np.bincount(at, mine, BINS), np.bincount(at, minlength=BINS)
            j += 1
    return out


def _to_sum(tree: Tree, level: int, least: int) -> list[int]:
    """The nodes of a level to be summed: the root, then of two children that with fewer rows,
    where one of them has rows enough for a split."""
    if level == 0:
        return [0]
    return [i if tree.rows[i] <= tree.rows[i + 1] else i + 1
            for i in range(2 ** level - 1, 2 ** (level + 1) - 1, 2)
            if tree.feature[(i - 1) // 2] >= 0 and max(tree.rows[i:i + 2]) >= 2 * least]


def _split_level(fit: Fit, tree: Tree, level: int, above: dict[int, np.ndarray],
                 made: dict[int, np.ndarray], cuts: Sequence[np.ndarray]) -> dict[int, np.ndarray]:
    """Put the best splits of a level into the tree, from the sums that were made of its nodes
    and those of the level above; gives the sums of all its nodes."""
    features, sums = np.flatnonzero(fit.columns()), {}
    for i, mine in made.items():
        sums[i] = mine
        if level:
            sums[i + 1 if i % 2 else i - 1] = above[(i - 1) // 2] - mine
    found = [(-1, 0, *[0.0] * 5)] * 2 ** level
    for i, (g, h) in sums.items():
        f, *rest = best_splits(np.stack([g / fit.scale, h])[:, None], np.ones(len(features), bool),
                               fit.params.min_child_weight)[0]
        found[i - 2 ** level + 1] = int(features[f]) if f >= 0 else f, *rest
    _place(tree, found, level, fit.params.learning_rate, cuts)
    return sums


def _grown_alone(block, fit: Fit, cuts: Sequence[np.ndarray],
                 used: np.ndarray | None = None) -> Fit:
    """All rounds of a fit over a block of all its rows, in exact sums. ``used`` are the places
    of the block's rows among all rows of its parts, where it has not all of them."""
    parts, columns, y, splits = block
    _begun([fit], _means(block, [fit]))
    code = splits[:, fit.split]
    mine = np.flatnonzero(code)
    if len(mine) < len(y):
        columns, y, code = columns.take(mine, axis=1), y[mine], code[mine]
        used = mine if used is None else used[mine]
    held, learnt = np.flatnonzero(code == VAL), np.flatnonzero(code == TRAIN)
    scores = np.full(len(y), fit.base)
    while fit.open:
        off = scores - y
        if fit.watched and fit.trees:
            late = off.take(held)
            fit.measured(float(late @ late / len(late)))
            if not fit.open:
                break
        rows = learnt
        if fit.params.subsample < 1:
            drawn = fit.drawn(parts)
            rows = rows[(drawn if used is None else drawn.take(used)).take(rows)]
        grads, features = np.rint(off * fit.scale), np.flatnonzero(fit.columns())
        tree, at, sums = Tree(fit.params.max_depth), {0: rows}, {}
        for level in range(tree.depth):
            made = {i: _node_sums(columns, at[i], grads, features)
                    for i in _to_sum(tree, level, fit.params.min_child_weight)}
            sums = _split_level(fit, tree, level, sums, made, cuts)
            below = {}
            for i in sums if level + 1 < tree.depth else ():
                if tree.feature[i] >= 0:
                    right = columns[tree.feature[i]].take(at[i]) > tree.bin[i]
                    below[2 * i + 1], below[2 * i + 2] = at[i][~right], at[i][right]
            at = below
        fit.trees.append(tree)
        if not fit.watched:
            fit.open = len(fit.trees) < fit.params.rounds
        scores += tree.value[tree.walk(columns, tree.bin)]
    return fit


def _grow_in_tasks(blocks: RDD, fits: list[Fit], cuts: Sequence[np.ndarray],
                   paired_rows: int = PAIRED_ROWS) -> list[Fit]:
    """All fits over a frame of one block, in one job: a task a fit, on any executor, which
    reads the block once. Those with deep trees and slow rates come first, as they take
    longest. What is lost with an executor is its unfinished fits."""
    def grown_of(block, fit: Fit) -> Fit:
        grow = _grown_alone if len(block[2]) > paired_rows else _grown_in_block
        return grow(block, fit, cuts)

    longest = sorted(enumerate(fits), key=lambda f: (-f[1].params.max_depth,
                                                     f[1].params.learning_rate))
    numbered = blocks.context.parallelize(longest, len(fits))
    grown = dict(blocks.cartesian(numbered).map(
        lambda pair: (pair[1][0], grown_of(pair[0], pair[1][1]))).collect())
    return [grown[i] for i in range(len(fits))]


def _grow_apart(blocks: RDD, fits: list[Fit], cuts: Sequence[np.ndarray]) -> list[Fit]:
    """Fits that need few rows of a frame of many blocks: the rows of each split are gathered
    in one task, which grows its fits."""
    of_split: dict[int, list[int]] = {}
    for k, f in enumerate(fits):
        of_split.setdefault(f.split, []).append(k)
    splits = list(of_split)

    def taken(block) -> Iterator[tuple]:
        parts, columns, y, codes = block
        for number, s in enumerate(splits):
            mine = np.flatnonzero(codes[:, s])
            yield number, (parts, mine, columns.take(mine, axis=1), y[mine], codes[mine])

    def grown(pieces: Iterable[tuple]) -> Iterator[tuple]:
        pieces = list(pieces)
        if pieces:
            number = pieces[0][0]
            parts, places, columns, y, codes = zip(*(p for _, p in pieces))
            before = np.cumsum([0, *[sum(n for _, n in p) for p in parts[:-1]]])
            used = np.concatenate([m + lo for m, lo in zip(places, before)])
            block = (tuple(p for n in parts for p in n), np.concatenate(columns, axis=1),
                     np.concatenate(y), np.concatenate(codes))
            del pieces, columns
            for k in of_split[splits[number]]:
                yield k, _grown_alone(block, fits[k], cuts, used)

    done = dict(blocks.flatMap(taken).partitionBy(len(splits), int).mapPartitions(grown).collect())
    return [done[k] for k in range(len(fits))]


def _level_sums(block, fit: Fit, tree: Tree, level: int, scores: np.ndarray
                ) -> Iterator[tuple[object, np.ndarray]]:
    """Of one block: the sums of the nodes to be summed, and before the first level the
    validation error."""
    parts, columns, y, splits = block
    off, code = scores - y, splits[:, fit.split]
    if level == 0:
        held = off[code == VAL]
        yield "val", np.array([held @ held, len(held)])
    part = code == TRAIN
    if fit.params.subsample < 1:
        part &= fit.drawn(parts)
    grads, features = np.rint(off * fit.scale), np.flatnonzero(fit.columns())
    node = tree.walk(columns, tree.bin, level)
    for i in _to_sum(tree, level, fit.params.min_child_weight):
        yield i, _node_sums(columns, np.flatnonzero(part & (node == i)), grads, features)


def _grow_group(blocks: RDD, fits: list[Fit], cuts: Sequence[np.ndarray]) -> None:
    """All fits of a group over several blocks, a tree each in every round until all have
    stopped.

    A level is a job that adds up histograms; the driver has those of two levels. Each
    ``REFRESH`` rounds the scores of all trees so far are stored. Scores come from the blocks
    and the trees alone: the lineage stays short, and what is lost with an executor is worked
    out again.
    """
    _begun(fits, blocks.map(lambda b: _means(b, fits)).treeReduce(np.add))
    stored, round_ = None, 0
    while any(f.open for f in fits):
        if round_ % REFRESH == 0:
            old, base = stored, list(fits)
            stored = blocks.map(lambda b, base=[replace(f, trees=list(f.trees)) for f in base]:
                                _scores(b, base)).persist(StorageLevel.MEMORY_AND_DISK)
            known = [len(f.trees) for f in fits]
            both = blocks.zip(stored)
            if old is not None:
                old.unpersist()
        now = {k: f for k, f in enumerate(fits) if f.open}
        sent = {k: replace(f, trees=f.trees[known[k]:], errors=[], before=known[k])
                for k, f in now.items()}
        growing = {k: Tree(f.params.max_depth) for k, f in now.items()}
        sums: dict[int, dict] = {k: {} for k in now}
        for level in range(max(t.depth for t in growing.values())):
            wanted = {k: t for k, t in growing.items() if level < t.depth
                      and _to_sum(t, level, fits[k].params.min_child_weight)}
            if not wanted:
                break

            def one(pair, wanted=wanted, level=level):
                block, scores = pair
                for k, tree in wanted.items():
                    score = scores[k] + sum((t.value[t.walk(block[1], t.bin)]
                                             for t in sent[k].trees), 0.0)
                    for what, found in _level_sums(block, sent[k], tree, level, score):
                        yield (k, what), found

            found = both.flatMap(one).reduceByKey(
                np.add, min(2 * len(wanted), both.getNumPartitions())).collect()
            made: dict[int, dict] = {}
            for (k, what), mine in found:
                made.setdefault(k, {})[what] = mine
            for k, tree in wanted.items():
                if level == 0:
                    off, n = made[k].pop("val")
                    if fits[k].watched and fits[k].trees:
                        fits[k].measured(float(off / n))
                        if not fits[k].open:
                            del growing[k]
                            continue
                sums[k] = _split_level(fits[k], tree, level, sums[k], made[k], cuts)
            if not growing:
                break
        for k, tree in growing.items():
            fits[k].trees.append(tree)
            if not fits[k].watched:
                fits[k].open = len(fits[k].trees) < fits[k].params.rounds
        round_ += 1
    if stored is not None:
        stored.unpersist()


def fit_many(frame: DataFrame, jobs: Sequence[Job], target: str, parallel: int = 8,
             block_rows: int = BLOCK_ROWS, whole_rows: int = WHOLE_ROWS,
             paired_rows: int = PAIRED_ROWS) -> dict[str, Fitted]:
    """All fits over one binned frame.

    Over a frame of one block each fit is a task, and so is, over more blocks, a fit whose
    own rows would be one block. The others grow in step by groups; groups are jobs of their
    own, submitted from ``parallel`` threads, or as many as there are cores, into scheduler
    pools. Bins are cut on rows that every fit trains on (if there are any), so no fit sees
    values of its future. The driver gets the cut points, and over more blocks the histograms
    of a level, whose size does not depend on the rows.
    """
    spark = frame.sparkSession
    parallel = max(parallel, spark.sparkContext.defaultParallelism)
    features = list(dict.fromkeys(f for j in jobs for f in j.features))
    splits: dict[str, Column] = {}
    for j in jobs:
        splits.setdefault(str(j.split), j.split)
    place = {name: i for i, name in enumerate(splits)}
    train = [F.coalesce(s == "train", F.lit(False)) for s in splits.values()]
    common = frame.where(reduce(and_, train))
    if common.isEmpty():
        common = frame.where(reduce(or_, train))
    cuts = cut_points(common, features)
    blocks = packed_blocks(frame, features, target, list(splits.values()), cuts, block_rows,
                           whole_rows)
    count = blocks.count()
    fits = [Fit(j.params, place[str(j.split)], np.isin(features, j.features)) for j in jobs]

    def run(numbered: tuple[int, list[Fit]]) -> list[Fit]:
        number, group = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % parallel}")
        _grow_group(blocks, group, cuts)
        return group

    if count == 1:
        grown = dict(enumerate(_grow_in_tasks(blocks, fits, cuts, paired_rows)))
    elif count:
        rows = blocks.map(lambda b: np.count_nonzero(b[3], axis=0)).reduce(np.add)
        apart = [k for k, f in enumerate(fits) if rows[f.split] <= whole_rows]
        step = [k for k, f in enumerate(fits) if rows[f.split] > whole_rows]
        grown = dict(zip(apart, _grow_apart(blocks, [fits[k] for k in apart], cuts))) if apart else {}
        groups = [[fits[k] for k in step[lo:lo + IN_STEP]] for lo in range(0, len(step), IN_STEP)]
        with ThreadPoolExecutor(parallel) as pool:
            grown |= zip(step, [f for group in pool.map(inheritable_thread_target(spark)(run),
                                                        enumerate(groups)) for f in group])
    else:
        grown = dict(enumerate(fits))
    blocks.unpersist()
    out = {}
    for i, j in enumerate(jobs):
        f = grown[i]
        best = int(np.argmin(f.errors)) if f.errors else len(f.trees) - 1
        out[j.name] = Fitted(features, f.base, f.trees[:best + 1], best, f.errors)
    return out
