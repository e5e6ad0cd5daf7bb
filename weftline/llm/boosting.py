"""Gradient-boosted trees on small tables of numbers, and thresholds calibrated on examples held out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 32, 4.0, 1.0


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: rows of features and cuts by node in breadth-first order, and of values by leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


#: Sums are of whole numbers, so that their order, and with it the dealing of rows to tasks, doesn't matter.
UNIT = float(1 << 24)


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """At most BINS - 1 quantiles of sorted values that occur so often."""
    ends = np.cumsum(counts)
    at = np.floor((ends[-1] - 1) * np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.int64)
    return np.unique(values[np.searchsorted(ends, at, "right")])


def binned(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The bin of each value; it is beyond a cut if its bin is beyond the cut's place."""
    return np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


class Growing:
    """Trees for the log odds of labels, by Newton steps on the logistic loss over histograms, a level at a time.

    A split leaves rows of a total weight of LEAST on either side. Equal gains go to the first feature and the lowest
    cut, so that equal rows give equal trees. Sums over rows may be made in parts and added.
    """

    def __init__(self, cuts: list[np.ndarray], weight: tuple[float, float], share: float):
        self.cuts, self.weight = cuts, weight
        share = float(np.clip(share, 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._start()

    def _start(self) -> None:
        self.depth, self.feature, self.place = 0, np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255, np.int64)

    def _nodes(self, codes: np.ndarray, feature: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(depth):
            node = 2 * node + 1 + (codes[rows, feature[node]] > place[node])
        return node

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for feature, place, value in self.done:
            out += value[self._nodes(codes, feature, place, DEPTH) - len(feature)]
        return out

    def sums(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gradients, curvatures and weights of rows that occur n times, by node of the level, feature and bin."""
        p = 1 / (1 + np.exp(-self.scores(codes)))
        weight = np.where(y > 0, self.weight[1], self.weight[0])
        node = self._nodes(codes, self.feature, self.place, self.depth) - (2**self.depth - 1)
        width, count = codes.shape[1], 2**self.depth
        place = (node[:, None] * (width * BINS) + np.arange(width) * BINS + codes).ravel()
        values = [np.rint(v * UNIT) * n for v in (weight * (p - y), weight * p * (1 - p), weight)]
        return np.stack([np.bincount(place, np.repeat(v, width), count * width * BINS) for v in values]).astype(np.int64)

    def split(self, sums: np.ndarray) -> None:
        """Splits the nodes of the level by their rows' sums; after the last level, gives the leaves their values."""
        count, width = 2**self.depth, len(self.cuts)
        left = [x.cumsum(2) / UNIT for x in sums.reshape(3, count, width, BINS)]
        total = [x[:, :, -1:] for x in left]
        gain = left[0] ** 2 / (left[1] + RIDGE) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
        gain[(left[2] < LEAST) | (total[2] - left[2] < LEAST)] = 0
        gain = np.round(gain, 9).reshape(count, -1)
        leaves = np.zeros((2, count, 2))
        for i, best in enumerate(gain.argmax(1).tolist()):
            j, bin_ = divmod(best, BINS)
            leaves[:, i, 0] = total[0][i, 0, 0], total[1][i, 0, 0]
            if gain[i, best] > 1e-6 and bin_ < len(self.cuts[j]):
                self.feature[count - 1 + i], self.place[count - 1 + i] = j, bin_
                leaves[:, i, 0] = left[0][i, j, bin_], left[1][i, j, bin_]
                leaves[:, i, 1] = total[0][i, j, 0] - leaves[0, i, 0], total[1][i, j, 0] - leaves[1, i, 0]
        self.depth += 1
        if self.depth == DEPTH:
            g, h = leaves.reshape(2, -1)
            self.done.append((self.feature, self.place, -RATE * g / (h + RIDGE)))
            self._start()

    def trees(self) -> Trees:
        cut = [np.array([self.cuts[j][b] if b < 255 else np.inf for j, b in zip(f, p, strict=True)]) for f, p, _ in self.done]
        return Trees(self.base, np.array([f for f, _, _ in self.done]), np.array(cut), np.array([v for _, _, v in self.done]))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Trees of rows at hand with one weight for each label, as Growing grows them."""
    own = tuple(float(weight[y == v].mean()) for v in (0, 1))
    cuts = [cuts_of(*np.unique(c, return_counts=True)) for c in x.T]
    codes, grown = binned(cuts, x), Growing(cuts, own, np.average(y, weights=weight))
    for _ in range(rounds * DEPTH):
        grown.split(grown.sums(codes, y, np.ones(len(y))))
    return grown.trees()


def calibrated_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The smallest held-out score above or at which `precision` of the examples are positive, with one more negative than seen; infinite if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, good, w = scores[order], y[order] > 0, weight[order]
    one = float(w[~good].mean()) if (~good).any() else 1.0
    share = np.cumsum(w * good) / (np.cumsum(w) + one)
    ends = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores are taken together
    fine = np.flatnonzero((share >= precision) & ends)
    return float(s[fine[-1]]) if len(fine) else float("inf")
