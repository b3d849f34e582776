"""Small gradient-boosted trees on weighted rows, scored as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, RATE, CUTS, LEAST, RIDGE = 24, 0.3, 16, 5, 1.0


@dataclass
class Tree:
    """A split into two splits; each part is (feature, threshold, value if at most the threshold, value otherwise)."""

    feature: int
    threshold: float
    low: tuple[int, float, float, float]
    high: tuple[int, float, float, float]

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda p: np.where(x[:, p[0]] <= p[1], p[2], p[3])
        return np.where(x[:, self.feature] <= self.threshold, side(self.low), side(self.high))


@dataclass
class Boosted:
    bias: float
    trees: list[Tree]
    slope: float = 1.0  # calibration of the margin
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def column(self, f: Column) -> Column:
        """The calibrated probability for a column that is an array of features. The trees are arrays of constants that one
        fold goes through, so the expression is small however many there are."""

        def part(pick):
            """Feature, threshold and values of a part of each tree."""
            rows = [pick(t) for t in self.trees]
            return [F.lit([int(r[0]) for r in rows]), *[F.lit([float(r[i]) for r in rows]) for i in range(1, len(rows[0]))]]

        if not self.trees:
            return F.lit(float(1 / (1 + np.exp(-(self.slope * self.bias + self.shift)))))
        (at, cut), low, high = part(lambda t: (t.feature, t.threshold)), part(lambda t: t.low), part(lambda t: t.high)
        under = lambda i, feature, limit: F.get(f, F.get(feature, i)) <= F.get(limit, i)
        side = lambda i, p: F.when(under(i, p[0], p[1]), F.get(p[2], i)).otherwise(F.get(p[3], i))
        add = lambda total, i: total + F.when(under(i, at, cut), side(i, low)).otherwise(side(i, high))
        total = F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(float(self.bias)), add)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * self.slope + self.shift)))


def between(v: np.ndarray) -> np.ndarray:
    """At most ``CUTS`` thresholds between sorted distinct values."""
    mid = (v[1:] + v[:-1]) / 2
    return mid if len(mid) <= CUTS else mid[np.linspace(0, len(mid) - 1, CUTS).astype(int)]


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    out = []
    for j in range(x.shape[1]):
        out.append(between(np.unique(x[:, j])))
    return out


def _best(b, g, h, w, cuts) -> tuple[float, int, float]:
    """Gain, feature and threshold of the best split; ``b`` has the number of each feature's cuts below a value."""
    top = (0.0, 0, np.inf)
    all_g, all_h, all_w = g.sum(), h.sum(), w.sum()
    whole = all_g**2 / (all_h + RIDGE)
    for j, own in enumerate(cuts):
        below = [np.cumsum(np.bincount(b[:, j], v, len(own) + 1)) for v in (g, h, w)]
        for c, gl, hl, n in zip(own, *below, strict=False):
            if min(n, all_w - n) < LEAST:
                continue
            gain = gl**2 / (hl + RIDGE) + (all_g - gl) ** 2 / (all_h - hl + RIDGE) - whole
            if gain > top[0] + 1e-9:
                top = (float(gain), j, float(c))
    return top


def _side(x, b, g, h, w, cuts) -> tuple[int, float, float, float]:
    value = lambda m: float(-RATE * g[m].sum() / (h[m].sum() + RIDGE))
    _, j, c = _best(b, g, h, w, cuts)
    low = x[:, j] <= c
    return j, c if np.isfinite(c) else 1e300, value(low), value(~low)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> Boosted:
    """Trees on the rows that are not held out, the margin's calibration on those that are. weight: how many examples a row
    stands for; cuts: each feature's thresholds, taken from the rows if none are given."""
    weight = np.ones(len(x)) if weight is None else weight.astype(float)
    xt, yt, wt = x[~held], y[~held].astype(float), weight[~held]
    p = min(max(float(np.average(yt, weights=wt)) if len(yt) else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), [])
    cuts, f = _cuts(xt) if cuts is None else cuts, np.full(len(xt), model.bias)
    b = np.stack([np.searchsorted(c, xt[:, j]) for j, c in enumerate(cuts)], 1) if len(cuts) else np.zeros((len(xt), 0), int)
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-f))
        g, h = wt * (q - yt), wt * q * (1 - q)
        gain, j, c = _best(b, g, h, wt, cuts)
        if gain <= 1e-6:
            break
        low = xt[:, j] <= c
        t = Tree(j, c, _side(xt[low], b[low], g[low], h[low], wt[low], cuts), _side(xt[~low], b[~low], g[~low], h[~low], wt[~low], cuts))
        model.trees.append(t)
        f += t.values(xt)
    m, yh, wh = model.margin(x[held]), y[held].astype(float), weight[held]
    for _ in range(25):  # Newton's steps with a little shrinkage
        if len(np.unique(yh)) < 2:
            break
        q = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30)))
        w = wh * q * (1 - q)
        grad = np.array([(wh * (q - yh) * m).sum() + 0.1 * (model.slope - 1), (wh * (q - yh)).sum() + 0.1 * model.shift])
        hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        model.slope, model.shift = float(model.slope - step[0]), float(model.shift - step[1])
    return model
