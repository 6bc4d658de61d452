"""Gradient-boosted trees in numpy: small, for tasks that each hold the whole model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """One score per class; softmax-free, each class against the rest."""

    edges: list[np.ndarray]
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)
    base: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)],
                        axis=1).astype(np.uint8)

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes, normalised per row."""
        b = self.binned(x)
        rows = np.arange(len(b))
        score = np.tile(self.base, (len(b), 1))
        for c, trees in enumerate(self.trees):
            for feature, split, value in trees:
                at = np.zeros(len(b), np.int64)
                while (inner := at < len(feature)).any():
                    own = rows[inner]
                    node = at[inner]
                    at[inner] = 2 * node + 1 + (b[own, feature[node]] > split[node])
                score[:, c] += value[at - len(feature)]
        p = 1 / (1 + np.exp(-np.clip(score, -15, 15)))
        return np.log(p / p.sum(axis=1, keepdims=True))


def boost(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 36, depth: int = 5,
          rate: float = 0.4) -> Boosted:
    """Logistic boosting on binned features; complete trees of `depth` levels.

    A node without a useful split sends all its rows to the left.
    """
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1]))
             for i in range(x.shape[1])]
    # A value on an edge belongs above it, so two-valued features keep one edge at the top.
    model = Boosted(edges, [[] for _ in range(classes)])
    b = model.binned(x).astype(np.int64)
    flat = b + np.arange(b.shape[1]) * BINS
    share = np.clip(np.bincount(y, minlength=classes) / len(y), 1e-3, 1 - 1e-3)
    model.base = np.log(share / (1 - share))
    for c in range(classes):
        target = (y == c).astype(float)
        score = np.full(len(y), model.base[c])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = target - p, p * (1 - p)
            tree, leaf = _tree(flat, b, g, h, depth)
            value = tree[2] * rate
            model.trees[c].append((tree[0], tree[1], value))
            score += value[leaf]
    return model


def _tree(flat: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    inner = 2 ** depth - 1
    feature, split = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    at = np.zeros(len(g), np.int64)
    width = b.shape[1]
    for level in range(depth):
        for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
            own = np.flatnonzero(at == node)
            if len(own) >= 8:
                cells = flat[own].ravel()
                sums = [np.bincount(cells, np.repeat(w[own], width), width * BINS).reshape(
                    width, BINS).cumsum(axis=1) for w in (g, h)]
                left_g, left_h = sums
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (
                    all_h - left_h + 1) - all_g ** 2 / (all_h + 1)
                gain[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[node], split[node] = divmod(best, BINS)
            at[own] = 2 * node + 1 + (b[own, feature[node]] > split[node])
    leaf = at - inner
    total = [np.bincount(leaf, w, 2 ** depth) for w in (g, h)]
    return (feature, split, total[0] / (total[1] + 1)), leaf
