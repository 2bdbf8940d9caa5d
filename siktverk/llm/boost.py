"""Gradient-boosted trees for two classes, small enough to travel to every worker."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEPTH, BINS = 3, 32


def matrix(rows: list[list[float]]) -> np.ndarray:
    """Rows of equal length as a matrix, also when there are none."""
    return np.array(rows, dtype=float) if rows else np.zeros((0, 1))


def cuts_of(values: np.ndarray) -> np.ndarray:
    """The bounds of the quantile bins of a feature."""
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of the features of ``x``, one row a feature."""
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]).astype(np.uint8) if cuts else np.zeros((0, len(x)), dtype=np.uint8)


@dataclass
class Boosted:
    """Complete trees of depth 3 on quantile bins, with logistic loss."""

    rounds: int = 40
    rate: float = 0.25
    ridge: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """``y`` is 0 or 1. One class only, or no rows at all, gives a constant answer."""
        cuts = [cuts_of(x[:, j]) for j in range(x.shape[1])] if len(y) else []
        return self.fit_binned(bins(x, cuts), y, np.ones(len(y)), cuts)

    def fit_binned(self, binned: np.ndarray, y: np.ndarray, times: np.ndarray, cuts: list[np.ndarray]) -> Boosted:
        """As :meth:`fit`, from the bins (one row a feature) that ``cuts`` bound; each row counts ``times``."""
        n = len(y)
        share = min(max(float(np.average(y, weights=times)) if n else 0.0, 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if n < 2 or y.min() == y.max():
            return self
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = times * (y - p), times * p * (1 - p)
            feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
            at = np.zeros(n, dtype=np.int64)
            for node in range(2**DEPTH - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf, 0)
                if times[rows].sum() >= 10:
                    gs, hs = g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + self.ridge)
                    for j, c in enumerate(cuts):
                        if len(c):
                            b = binned[j, rows]
                            left_g = np.cumsum(np.bincount(b, gs, len(c) + 1))[:-1]
                            left_h = np.cumsum(np.bincount(b, hs, len(c) + 1))[:-1]
                            gain = left_g**2 / (left_h + self.ridge) + (gs.sum() - left_g) ** 2 / (hs.sum() - left_h + self.ridge) - whole
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), j, float(c[k]), k)
                feature[node], threshold[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (binned[best[1], rows] > best[3] if best[2] < np.inf else False)
            leaf = at - (2**DEPTH - 1)
            value = self.rate * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + self.ridge)
            self.trees.append((feature, threshold, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] >= threshold[at])
            score += value[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))
