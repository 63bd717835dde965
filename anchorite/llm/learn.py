"""Small models trained with numpy: a one-layer network, Adam, and the bounded samples they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Net:
    """f(x) = w2 . tanh(x' W1 + b1) + b2, over standardised x'."""

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.params = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def standardise(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.params
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w1 + b1)
        return h @ w2 + b2, h, z

    def backward(self, d: np.ndarray, h: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        """Gradients for a loss whose derivative by f is ``d``."""
        w2 = self.params[2]
        dh = d[:, None] * w2 * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]


def sample_ids(frame: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n ids, those first in a hashed order; always the same for the same input."""
    return frame.select("doc_id").where("doc_id is not null").distinct().orderBy(frames.hashed_order("doc_id", seed), "doc_id").limit(n)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of a bounded set of ids (the result of sample_ids), found by broadcast: one row for each id, its least text where rows share an id.

    So the result has no more rows than ids, however often a row is repeated.
    """
    return docs.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def platt(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a f + b) fitted to weighted labels by Newton steps; the identity without both classes."""
    if len(f) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(60):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - t)) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        w -= np.clip(np.linalg.solve(h, g), -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
