"""What the two classifiers share: folds, bounded samples of labelled rows, and a minimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and y of at most `rows` labelled documents where learn holds, the first by hash of the id.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts.
    The ids and labels alone go through the driver.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & learn)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    small = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in chosen], "id long, y int")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.join(F.broadcast(small), "id")


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < 1e-6:
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(grad).sum())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, q @ grad
        if slope <= 0:
            past.clear()
            q, slope = grad, grad @ grad
            step = 1.0 / max(1.0, np.abs(grad).sum())
        for _ in range(30):
            new_value, new_grad = loss(x - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-10:
            past.append((s, y))
            del past[:-memory]
        x, value, grad = x + s, new_value, new_grad
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the columns of x, the last an intercept that bears no penalty."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[:-1] + w[-1]
        own = np.append(w[:-1], 0)
        return float(np.mean(np.logaddexp(0, z) - y * z) + ridge * own @ own / 2), np.append(x.T @ (sigmoid(z) - y), (sigmoid(z) - y).sum()) / len(y) + ridge * own

    return minimise(loss, np.zeros(x.shape[1] + 1))
