"""A linear hinge-loss model fitted by dual coordinate descent, for bounded training samples."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def fit_hinge(rows: list[Row], y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 12, seed: int = 7, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (dims + 1 values, the last is the bias) of an L1-loss linear SVM on sparse rows (indices, values); y is -1 or 1."""
    w = np.zeros(dims + 1)
    if not rows:
        return w
    cost = np.full(len(rows), c) if weight is None else c * weight
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            ids, values = rows[i]
            g = y[i] * (w[ids] @ values + w[-1]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[ids] += step * values
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def margins(rows: list[Row], w: np.ndarray) -> np.ndarray:
    return np.array([w[ids] @ values + w[-1] for ids, values in rows]) if rows else np.zeros(0)


def fit_sigmoid(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a * m + b))) fits labels y of -1 or 1, by Newton steps on smoothed targets."""
    if not len(m):
        return 1.0, 0.0
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b
