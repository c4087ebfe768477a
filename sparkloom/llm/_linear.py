"""Logistic regression on sparse rows, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Sparse:
    """Rows of (column, value) pairs."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, cols: int):
        self.row, self.col, self.value, self.rows, self.cols = row, col, value, rows, cols

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.rows).astype(float)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.cols).astype(float)


def fit_logistic(x: Sparse, target: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 200, intercept: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets between 0 and 1: accelerated gradient steps of the largest safe size. An ``intercept`` that is given stays as it is."""
    weight = np.ones(x.rows) if weight is None else weight
    v, total = np.full(x.cols, 1.0), weight.sum() + 1e-9
    for _ in range(15):  # the largest curvature, by power iteration
        v = x.tdot(weight * x.dot(v))
        top = np.linalg.norm(v) + 1e-12
        v /= top
    step = 1 / (0.25 * max(top, weight.max(initial=0)) + 0.25 * total / 10 + l2 + 1e-9)
    w, b, pw, pb = np.zeros(x.cols), 0.0, np.zeros(x.cols), 0.0
    b = pb = float(np.log((weight @ target + 1) / (weight @ (1 - target) + 1))) if intercept is None else intercept
    for k in range(steps):
        m = k / (k + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        r = weight * (sigmoid(x.dot(yw) + yb) - target)
        pw, pb = w, b
        w, b = yw - step * (x.tdot(r) + l2 * yw), yb - (min(4 / total, 10 * step) * r.sum() if intercept is None else 0.0)
    return w, b


def platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is a probability: Newton steps, lightly held to a = 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * margin + b)
        g = np.array([((p - target) * margin).sum() + (a - 1), (p - target).sum() + 1e-3 * b])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / (abs(d).max() + 1e-12))  # no wild steps
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)
