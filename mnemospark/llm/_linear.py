"""Small dense logistic models, fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of least logistic loss against soft labels y, by Newton's method; no intercept but a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pairwise(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-4, rounds: int = 25, block: int = 1000) -> np.ndarray:
    """Weights of least mean logistic loss over the differences of every row of good and every row of bad, by Newton's method in blocks."""
    w, n = np.zeros(good.shape[1]), len(good) * len(bad)
    for _ in range(rounds):
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        below = (bad @ w).astype(np.float32)
        across, total = np.zeros(len(bad)), np.zeros(len(bad))
        for at in range(0, len(good), block):
            x = good[at : at + block]
            p = 1 / (1 + np.exp(np.clip((x @ w).astype(np.float32)[:, None] - below, -80, 80)))
            q = p * (1 - p)
            g -= p.sum(axis=1) @ x
            across += p.sum(axis=0)
            total += q.sum(axis=0)
            mixed = x.T @ (q @ bad)
            h += (x * q.sum(axis=1)[:, None]).T @ x - mixed - mixed.T
        g = (g + across @ bad) / n + ridge * w
        h = (h + (bad * total[:, None]).T @ bad) / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learning_ids(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int, most: int) -> DataFrame:
    """(id, label): at most ``most`` labelled ids outside the held-out fold, taken in the order of a hash of the id; of several labels of an id the greatest."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & outside(F.col("id"), folds, held))
    return rows.groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)


def outside(i: Column, folds: int, held: int) -> Column:
    """Whether an id is outside the held-out fold."""
    return F.crc32(F.encode(i.cast("string"), "UTF-8")) % folds != held


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of the ids, which are few: one row an id, the least of its texts if it is repeated."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


def held_out(ids: list, folds: int, held: int) -> list[bool]:
    import zlib

    return [i is not None and zlib.crc32(str(i).encode()) % folds == held for i in ids]
