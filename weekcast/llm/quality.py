"""Quality scores by a kernel machine on document statistics.

Each text is described by statistics of its characters, words and lines. Random
Fourier features, cosines of random projections, approximate a Gaussian kernel over
them; ridge regression on these features is solved from normal equations that are
summed by partition. An isotonic fit on a fold of its own turns the ridge output into
the share of good texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import row_number, ship_code, write_stage
from weekcast.llm.learned import isotonic, remainder

FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 11
BINS = 2000                        # cells of the ridge output that the isotonic fit sees
FIT_FOLDS, CHECK_FOLD = (1, 2, 3), 4
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = "!?.,;:|*#%&$@<>/\\=_-\"'()[]{}"


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text of any length; all finite, also for an empty one."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(1 for x in words if x.isupper() and len(x) > 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    marks = [text.count(c) / n for c in "!|*#%&$@<"]
    lengths = np.fromiter(map(len, words), float, len(words))
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)),
        len(counts) / w, top / w, repeats / w, upper / w, letters / n,
        float(lengths.mean()) if words else 0.0, float(lengths.std()) if words else 0.0,
        sum(text.count(c) for c in _MARKS) / n, sum(map(text.count, "0123456789")) / n,
        text.count(". ") / w, text.count(",") / w,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        *[math.sqrt(m) for m in marks],
    ]


SIZE = len(statistics(""))


def described(docs: DataFrame) -> DataFrame:
    """row, doc_id and stats (an array) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                stats = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"),
                     pa.array(stats, pa.list_(pa.float64()))], names=["row", "doc_id", "stats"])

    ship_code(docs.sparkSession)
    return docs.select(row_number().alias("row"), "doc_id", "text").mapInArrow(
        run, T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"],
                           T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray              # ridge outputs and the calibrated scores there
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """A constant and the random cosines of standardised statistics."""
        rng = np.random.default_rng(SEED)
        at = rng.normal(0.0, 1.0 / WIDTH, (SIZE, FEATURES))
        phase = rng.uniform(0.0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)),
                                math.sqrt(2 / FEATURES) * np.cos(x @ at + phase)])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the ridge output to order equal steps."""
        raw = self.ridge(stats)
        return 0.998 * np.interp(raw, self.edges, self.levels) + 0.002 / (1 + np.exp(-raw))


def stacked(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), SIZE)


def _sum(rows: DataFrame) -> DataFrame:
    """The sum of serialised vectors, a row for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("part"):
                x = np.frombuffer(v.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())],
                                             names=["part"])

    return rows.mapInArrow(run, "part binary")


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows of the folds that are not held out (crc32 of the id modulo
    5 is not 0): three for the regression, one for the calibration. Without labels every
    score is about 0.5. Rows without an id or a label are left out."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", F.col("quality").cast("double").alias("y")).distinct()
    rows = stats.join(known, "doc_id").select(
        "stats", "y", remainder(5).alias("fold"), F.xxhash64("doc_id").alias("h"))
    rows = write_stage(rows.where("fold <> 0"), "quality-examples")
    learn = rows.where(F.col("fold").isin(*FIT_FOLDS))
    moments = learn.agg(*[f(F.get("stats", F.lit(i))) for i in range(SIZE)
                          for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array([x or 0.0 for x in moments]).reshape(SIZE, 2).T
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1),
                  np.array([0.0]), np.array([0.5]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = FEATURES + 1
        left, right, count = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            z, y = model.features(stacked(batch.column("stats"))), batch.column("y").to_numpy()
            left, right, count = left + z.T @ z, right + z.T @ y, count + len(y)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.r_[left.ravel(), right, count].tobytes()], pa.binary())],
                names=["part"])

    parts = learn.select("stats", "y").mapInArrow(equations, "part binary")
    few = max(1, math.isqrt(parts.rdd.getNumPartitions()))     # two levels: root(n) to the driver
    sums = [np.frombuffer(r.part) for r in _sum(parts.repartition(few)).collect()]
    if not sums:
        return model
    total, n = np.sum(sums, axis=0), FEATURES + 1
    left, right, count = total[:n * n].reshape(n, n), total[n * n:-1], total[-1]
    penalty = np.eye(n) * RIDGE * count
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(left + penalty, right)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.ridge(stacked(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")],
                                             names=["raw", "y"])

    cell = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)),
                   F.lit(BINS - 1)).alias("cell")
    cells = (rows.where(F.col("fold") == CHECK_FOLD).select("stats", "y")
             .mapInArrow(outputs, "raw double, y double").groupBy(cell)
             .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), F.avg("raw").alias("at"))
             .orderBy("cell").collect())                       # BINS rows at most
    if cells:
        model.levels = isotonic(np.array([c.n for c in cells]), np.array([c.good for c in cells]))
        model.edges = np.array([c["at"] for c in cells])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, score (0 to 1) and predicted (score >= 0.3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(stacked(batch.column("stats")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(scores)],
                names=["row", "doc_id", "score"])

    scored = stats.select("row", "doc_id", "stats").mapInArrow(
        run, T.StructType([T.StructField("row", T.LongType()), stats.schema["doc_id"],
                           T.StructField("score", T.DoubleType())]))
    return scored.select("row", "doc_id", (remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, held_out, score and predicted of each row of ``docs``.

    Only whole texts are looked at; a null text is an empty one, and empty texts get a
    score like others. Ids may be null or repeat; other columns are not read. An empty
    table gives no rows.
    """
    stats = write_stage(described(docs), "statistics")
    return score(stats, fit(stats, labels))
