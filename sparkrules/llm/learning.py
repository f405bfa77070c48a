"""Small numpy learners on the driver, and bounded samples to fit them on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, most: int, id: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, the same ones each time: those with the smallest hash of the id."""
    return rows.orderBy(F.xxhash64(id), id).limit(most)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression, the intercept last (not penalised), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        size = np.abs(step).max(initial=0)
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def decide(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
