"""A random forest for two classes, in numpy."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int) -> list:
    """A tree as nested [feature, threshold, left, right] lists with shares of the positive class as leaves."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return [share]
    best, choice = 0.0, None
    for f in rng.choice(x.shape[1], min(tries, x.shape[1]), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, positive = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, total = positive[:-1], positive[-1]
        pure = p**2 / n + (n - p) ** 2 / n + (total - p) ** 2 / (len(y) - n) + (len(y) - n - total + p) ** 2 / (len(y) - n)
        pure = np.where((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least), pure, 0)
        i = int(pure.argmax())
        if pure[i] > best + 1e-9:
            middle = float((v[i] + v[i + 1]) / 2)
            best, choice = float(pure[i]), (int(f), middle if middle < v[i + 1] else float(v[i]))
    if choice is None:
        return [share]
    left = x[:, choice[0]] <= choice[1]
    return [*choice, _grow(x[left], y[left], rng, depth - 1, least, tries), _grow(x[~left], y[~left], rng, depth - 1, least, tries)]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 8, least: int = 3, seed: int = 5, weights: np.ndarray | None = None) -> list:
    """Trees, each grown on a bootstrap sample with a random choice of features at each node; a row with a weight stands for so many."""
    rng = np.random.default_rng(seed)
    tries = max(1, round(x.shape[1] ** 0.5))
    forest = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y)) if weights is None else rng.choice(len(y), round(weights.sum()), p=weights / weights.sum())
        forest.append(_grow(x[pick], y[pick].astype(np.float64), rng, depth, least, tries))
    return forest


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    """The mean share of the positive class in each row's leaves."""

    def run(node: list, rows: np.ndarray, out: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] += node[0]
            return
        left = x[rows, node[0]] <= node[1]
        if left.any():
            run(node[2], rows[left], out)
        if not left.all():
            run(node[3], rows[~left], out)

    total = np.zeros(len(x))
    for tree in forest:
        run(tree, np.arange(len(x)), total)
    return total / max(1, len(forest))
