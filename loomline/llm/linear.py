"""Sparse multinomial logistic regression by FTRL-proximal with elastic net, and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, coordinate by coordinate: weights are only ever derived from the sums of
    gradients (z) and of their squares (n), and are exactly 0 while |z| is within the L1 penalty."""

    def __init__(self, width: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-6):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        z, n = self.z[places], self.n[places]
        w, b = self._weights(z, n, self.l1), self._weights(self.bias_z, self.bias_n, 0.0)
        error = softmax(values @ w + b)
        error[label] -= 1.0
        g = values[:, None] * error
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[places] = z + g - sigma * w
        self.n[places] = n + g * g
        sigma = (np.sqrt(self.bias_n + error * error) - np.sqrt(self.bias_n)) / self.alpha
        self.bias_z += error - sigma * b
        self.bias_n += error * error

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n, self.l1), self._weights(self.bias_z, self.bias_n, 0.0)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    ratio, low, high = (np.sqrt(5) - 1) / 2, np.log(0.05), np.log(20.0)

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, classes: int, epochs: int = 2, calibration: int = 5, **penalties) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature from (places, values, label) rows in their order. Every calibration-th row is kept
    out of learning and sets the temperature."""
    model = Ftrl(width, classes, **penalties)
    for _ in range(epochs):
        for i, row in enumerate(rows):
            if i % calibration:
                model.learn(*row)
    w, b = model.weights()
    kept = rows[::calibration]
    scores = np.array([v @ w[p] + b for p, v, _ in kept]).reshape(-1, classes)
    return w, b, temperature(scores, np.array([y for _, _, y in kept], np.int64))
