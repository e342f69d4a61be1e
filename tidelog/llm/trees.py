"""Gradient-boosted trees for a yes or no, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic gradient boosting on binned features, starting from the share of ones."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.l2, self.least, self.bins = rounds, depth, rate, l2, least, bins
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def _edges(self, v: np.ndarray) -> np.ndarray:
        """Where a feature may be cut: at quantiles; where one value is that of most rows, at quantiles of the others and
        at each of the first few values too, so that rare features stay usable."""
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = np.quantile(v, at)
        common = v == np.median(v)
        if common.mean() >= 0.5 and not common.all():
            edges = np.concatenate([edges, np.unique(v)[: self.bins], np.quantile(v[~common], at)])
        return np.unique(edges)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y)) if weight is None else weight
        edges = [self._edges(x[:, j]) for j in range(x.shape[1])]
        width = max(len(e) for e in edges) + 1
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        offset = binned + np.arange(x.shape[1]) * width
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = weight * (prob - y), weight * prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)

            def sums(rows: np.ndarray) -> np.ndarray:
                """(2, features, bins): the sums of g and h of the rows in each bin."""
                flat = offset[rows].ravel()
                return np.stack([np.bincount(flat, np.repeat(v[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width) for v in (g, h)])

            open_ = {0: (np.arange(len(y)), sums(np.arange(len(y))))}
            for level in range(self.depth + 1):
                below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for k, (rows, of) in open_.items():
                    gs, hs = g[rows].sum(), h[rows].sum()
                    tree[k] = (-1, 0.0, float(-self.rate * gs / (hs + self.l2)))
                    if level == self.depth or hs < 2 * self.least:
                        continue
                    gh, hh = of.cumsum(2)
                    gain = gh**2 / (hh + self.l2) + (gs - gh) ** 2 / (hs - hh + self.l2) - gs**2 / (hs + self.l2)
                    gain[(hh < self.least) | (hs - hh < self.least)] = 0
                    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, cut] <= 1e-6 or cut >= len(edges[j]):
                        continue
                    tree[k] = (int(j), float(edges[j][cut]), tree[k][2])
                    right = binned[rows, j] > cut
                    node[rows] = 2 * k + 1 + right
                    parts = rows[~right], rows[right]
                    if level + 1 < self.depth:
                        # Only the smaller part is summed; the other is what is left.
                        few = int(len(parts[1]) < len(parts[0]))
                        own = sums(parts[few])
                        both = (own, of - own) if few == 0 else (of - own, own)
                    else:
                        both = (of, of)  # leaves look at no bins
                    below[2 * k + 1], below[2 * k + 2] = (parts[0], both[0]), (parts[1], both[1])
                open_ = below
            values = np.array([t[2] for t in tree])
            score += values[node]
            self.trees.append(tree)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            feature, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, values) of the non-decreasing step function nearest to y: pool adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([s, v, 1.0, s])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][0]):
            _, v2, w2, hi = blocks.pop()
            lo, v1, w1, _ = blocks.pop()
            blocks.append([lo, (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, hi])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
