"""Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties, on bounded samples."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights (classes x features) and biases, learnt one example at a time; most weights stay exactly 0.

    ``l1`` and ``l2`` are the elastic net's two penalties, ``alpha`` and ``beta`` set each coordinate's rate. Targets are distributions over the classes.
    """

    def __init__(self, classes: int, features: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((classes, features)), np.zeros((classes, features))
        self.zb, self.nb = np.zeros(classes), np.zeros(classes)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def _bias(self) -> np.ndarray:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        """``at`` and ``x``: places and values of the example's features."""
        z, n = self.z[:, at], self.n[:, at]
        w, b = self._weights(z, n), self._bias()
        error = softmax(w @ x + b) - target
        g = error[:, None] * x
        self.z[:, at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g
        self.zb += error - (np.sqrt(self.nb + error * error) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += error * error

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n), self._bias()


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-out examples, by golden section on its logarithm; 1 without any."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, part = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - part * (hi - lo), lo + part * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
