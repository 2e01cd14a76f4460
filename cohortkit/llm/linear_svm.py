"""Small linear support vector machines, fitted by dual coordinate descent on bounded samples."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (last one the bias) of an L2-regularised hinge-loss SVM; ``y`` is -1 or 1."""
    rng = np.random.default_rng(seed)
    norm, alpha, w, bias = np.einsum("ij,ij->i", x, x) + 1, np.zeros(len(x)), np.zeros(x.shape[1], "float32"), 0.0
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (float(w @ x[i]) + bias) - 1
            step = min(max(alpha[i] - slope / norm[i], 0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                bias += step * y[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return np.append(w, np.float32(bias))


class OneVersusOne:
    """A vote of pairwise SVMs; one class needs none."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((len(self.pairs), x.shape[1] + 1), "float32")
        for k, (a, b) in enumerate(self.pairs):
            rows = np.isin(y, [self.classes[a], self.classes[b]])
            # two classes need no copy of the rows
            self.weights[k] = fit_svm(x if rows.all() else x[rows], np.where(y[rows] == self.classes[a], 1, -1))

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and confidences (0 to 1: the winner's worst duel) from the pairs' margins, a row per text."""
        n = len(margins)
        if not self.pairs:
            return np.zeros(n, int), np.ones(n)
        votes, worst = np.zeros((n, len(self.classes))), np.full((n, len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            worst[:, a], worst[:, b] = np.minimum(worst[:, a], m), np.minimum(worst[:, b], -m)
        won = np.argmax(votes + 1e-3 * np.tanh(worst), axis=1)
        return won, 1 / (1 + np.exp(-4 * worst[np.arange(n), won]))
