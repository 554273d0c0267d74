"""Gradient boosted trees over small whole-number features, and calibrated thresholds, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64  # features are whole numbers below this


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


@dataclass
class Boosted:
    """Complete trees: node k of a tree goes on to 2k + 1, or to 2k + 2 where its feature exceeds its cut."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 1

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return node - self.feature.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        total = np.full(len(x), self.start)
        for tree in range(len(self.feature)):
            total += self.value[tree, self.leaves(tree, x)]
        return total


def best_splits(x: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray, l2: float):
    """Per node the feature and cut of the largest gain; cut BINS - 1 (no split) where nothing is gained."""
    n, width = x.shape
    place = (node[:, None] * width + np.arange(width)) * BINS + x
    sums = [np.bincount(place.ravel(), np.repeat(v, width), n_nodes * width * BINS).reshape(n_nodes, width, BINS).cumsum(2)
            for v in (g, h)]
    (left_g, left_h), (all_g, all_h) = sums, [s[:, :1, -1:] for s in sums]
    gain = left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g ** 2 / (all_h + l2)
    gain = gain.round(9).reshape(n_nodes, -1)  # equal gains stay equal whatever the order of sums
    best = gain.argmax(1)
    none = gain[np.arange(n_nodes), best] <= 0
    return np.where(none, 0, best // BINS), np.where(none, BINS - 1, best % BINS)


def boosted(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0) -> Boosted:
    """Trees fitted to labels 0 and 1 with logistic loss; without both labels, the prior alone."""
    inner, prior = 2 ** depth - 1, (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(prior / (1 - prior))), np.zeros((rounds, inner), np.int64),
                    np.full((rounds, inner), BINS - 1), np.zeros((rounds, inner + 1)))
    if not 0 < y.sum() < len(y):
        return model
    total = np.full(len(x), model.start)
    for tree in range(rounds):
        p = sigmoid(total)
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            feature, cut = best_splits(x, node, first + 1, g, h, l2)
            model.feature[tree, first:2 * first + 1], model.cut[tree, first:2 * first + 1] = feature, cut
            node = 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])
        sums_g, sums_h = (np.bincount(node, v, inner + 1) for v in (g, h))
        model.value[tree] = -rate * sums_g / (sums_h + l2)
        total += model.value[tree, node]
    return model


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score whose share of label 1, made monotone (isotonic regression), is ``precision`` or more.

    Infinite where no score reaches it.
    """
    blocks: list[list[float]] = []  # label sum, weight, lowest score
    for value in np.unique(score):
        at = score == value
        blocks.append([float(y[at].sum()), float(at.sum()), float(value)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            labels, weight, _ = blocks.pop()
            blocks[-1][0] += labels
            blocks[-1][1] += weight
    return next((low for labels, weight, low in blocks if labels >= precision * weight), float("inf"))
