"""Helpers of the two classifiers: folds, examples and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(of: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``of``; a null id has the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def examples(docs: DataFrame, labels: DataFrame, label: str, allowed: Column,
             per_class: int) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``per_class`` rows of each label, in the order
    of a hash of their ids. Rows without an id, label or text are left out."""
    marked = labels.where(allowed & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = (docs.where("text IS NOT NULL").select("doc_id", "text")
             .join(F.broadcast(chosen), "doc_id")           # 2 * per_class ids at most
             .select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
             .orderBy("h", "text").limit(2 * per_class).collect())
    return [(r.text, r.y) for r in found]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, the last for the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the rising share of positives closest to the bins'."""
    blocks: list[list[float]] = []
    for n, k in zip(total, positive, strict=True):
        blocks.append([float(n), float(k), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, k1, m1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + k1, blocks[-1][2] + m1]
    return np.concatenate([np.full(int(m), k / n) for n, k, m in blocks])
