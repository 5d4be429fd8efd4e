"""Trees fitted by the driver on a bounded sample of labelled findings, and scored as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Labelled rows that a fit takes at most.
MOST_ROWS = 20_000


@dataclass
class Node:
    """A leaf has a value; any other node sends feature <= cut to the left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def sql(self, features: str) -> str:
        """The tree over an array expression of doubles."""
        if self.left is None:
            return f"{self.value:.12g}D"
        return f"CASE WHEN {features}[{self.feature}] <= {self.cut!r}D THEN {self.left.sql(features)} ELSE {self.right.sql(features)} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, leaf, choose) -> Node:
    """A regression tree on weighted squared error. leaf(rows) gives a value; choose() the features that a split may use."""

    def build(rows: np.ndarray, left: int) -> Node:
        node = Node(leaf(rows))
        y, w = target[rows], weight[rows]
        if not left or len(rows) < 2 * least or np.ptp(y) < 1e-12:
            return node
        best, mean = (1e-9, -1, 0.0), (w * y).sum() / w.sum()
        for f in choose():
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s, c = np.cumsum((w * (y - mean))[order]), np.cumsum(w[order])
            at = np.flatnonzero(np.diff(v[order]) > 0)
            at = at[(at + 1 >= least) & (len(rows) - at - 1 >= least)]
            if len(at):
                gain = s[at] ** 2 / c[at] + (s[-1] - s[at]) ** 2 / np.maximum(c[-1] - c[at], 1e-12)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-12:
                    lo, hi = v[order][at[k]], v[order][at[k] + 1]
                    # Of neighbouring floats the mean may be the upper one, which would leave nothing above the cut.
                    cut = float((lo + hi) / 2)
                    best = (float(gain[k]), f, cut if cut < hi else float(lo))
        if best[1] < 0:
            return node
        low = x[rows, best[1]] <= best[2]
        return Node(node.value, best[1], best[2], build(rows[low], left - 1), build(rows[~low], left - 1))

    return build(np.arange(len(x)), depth)


@dataclass
class Forest:
    """The mean of its trees' class shares."""

    trees: list[Node]

    def sql(self, features: str) -> str:
        return "(" + " + ".join(f"({t.sql(features)})" for t in self.trees) + f") / {len(self.trees)}D"

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, least: int = 4, seed: int = 17) -> Forest:
    """Bootstrap samples, and the square root of the features at each split."""
    rng, n, k = np.random.default_rng(seed), len(x), x.shape[1]
    out = []
    for _ in range(trees):
        rows = rng.integers(0, n, n)
        xs, ys = x[rows], y[rows].astype(float)
        out.append(grow(xs, ys, np.ones(n), depth, least, lambda r, ys=ys: float(ys[r].mean()), lambda: rng.choice(k, max(1, round(math.sqrt(k)) + 1), replace=False)))
    return Forest(out)


@dataclass
class Boosted:
    """Logistic of a base score plus the trees' steps."""

    base: float
    trees: list[Node]

    def sql(self, features: str) -> str:
        return f"1D / (1D + exp(-({self.base:.12g}D + " + " + ".join(f"({t.sql(features)})" for t in self.trees) + ")))"

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(t.predict(x) for t in self.trees))))


def gradient_boosting(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8) -> Boosted:
    """Newton steps on the logistic loss."""
    y = y.astype(float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base, out = math.log(share / (1 - share)), []
    f = np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree = grow(x, g / h, h, depth, least, lambda r, g=g, h=h: float(rate * np.clip(g[r].sum() / (h[r].sum() + 1), -4, 4)), lambda: range(x.shape[1]))
        out.append(tree)
        f = f + tree.predict(x)
    return Boosted(base, out)


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the precision holds; above all scores if none does."""
    order = np.argsort(-score, kind="stable")
    s, good = score[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(np.diff(s) != 0, True))
    fine = ends[good[ends] / (ends + 1) >= precision]
    if not len(fine):
        return 1.1
    last = fine[-1]
    return float((s[last] + s[last + 1]) / 2) if last + 1 < len(s) else float(s[last] / 2)
