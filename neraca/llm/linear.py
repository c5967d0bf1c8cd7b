"""Linear hinge-loss models fitted by dual coordinate descent on a bounded sample."""

from __future__ import annotations

import numpy as np


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float | np.ndarray = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss.

    ``rows`` are (feature numbers, values); ``y`` is +1 or -1; ``cost`` is one bound of the
    dual variables or one per row.  The last feature number is the caller's bias, if any.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    bound = np.broadcast_to(np.asarray(cost, float), (len(rows),))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            at, values = rows[i]
            slope = y[i] * float(w[at] @ values) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * values
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (positive) and shift of a sigmoid from margins to the chance of +1, by Newton steps
    on smoothed targets."""
    plus, minus = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
