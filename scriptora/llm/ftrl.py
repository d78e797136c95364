"""Follow-the-regularised-leader (proximal) with elastic-net penalties, for sparse examples."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``classes`` linear scores over ``features`` hashed features and a bias (the last column)."""

    def __init__(self, classes: int, features: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z = np.zeros((classes, features + 1))
        self.n = np.zeros((classes, features + 1))
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, features

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights(at) @ x

    def step(self, at: np.ndarray, x: np.ndarray, slope: np.ndarray) -> None:
        """slope: the loss's derivative by each class's score."""
        w = self.weights(at)
        g = slope[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores that minimises the log loss on held-back examples."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
