"""Weighted tree ensembles for regression, in numpy; no Spark here.

Squared error.  Rows of zero weight take no part.  Extra-Trees draws one uniform threshold
for each of a node's sampled features, random forests scan all midpoints.  A feature's
importance is its weighted decrease of impurity over the root's weight, normalised per
tree, averaged over the trees that split, and normalised again.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

PERSON = b"popnet01"


def task_seed(seed: int, group: str, target: str) -> int:
    """A model's seed from its identity alone, so scheduling doesn't matter."""
    text = json.dumps([seed, group, target], separators=(",", ":"), ensure_ascii=False).encode()
    return int.from_bytes(hashlib.blake2s(text, digest_size=4, person=PERSON).digest(), "little")


def n_features(rule: str | int | float, p: int) -> int:
    """Features sampled in a node."""
    if rule == "sqrt":
        return max(1, int(math.sqrt(p)))
    if rule == "log2":
        return max(1, int(math.log2(p)))
    if isinstance(rule, bool) or isinstance(rule, str):
        raise ValueError(f"unknown max_features {rule!r}")
    return min(p, rule) if isinstance(rule, int) else max(1, int(rule * p))


@dataclass(frozen=True)
class ForestParams:
    """How an ensemble is grown."""

    method: str = "extra-trees"
    n_estimators: int = 50
    max_features: str | int | float = 0.5
    min_samples_leaf: int = 2
    max_depth: int | None = None
    min_weight_fraction_leaf: float = 0.1
    bootstrap: bool | None = None

    @property
    def resamples(self) -> bool:
        """Whether rows are drawn with replacement: by default random forests do."""
        return self.method == "random-forest" if self.bootstrap is None else self.bootstrap


@dataclass
class Tree:
    """What is kept of a tree."""

    importances: np.ndarray
    nodes: int = 0
    leaves: int = 0
    depth: int = 0


@dataclass
class Forest:
    """Importances of an ensemble and its trees' shapes."""

    importances: np.ndarray
    shapes: list[tuple[int, int, int]] = field(default_factory=list)


def _leaf(n: int, wt: float, depth: int, p: ForestParams, least: float) -> bool:
    """Whether a node of ``n`` rows and weight ``wt`` is a leaf whatever its values are: then nothing of it is copied."""
    return (p.max_depth is not None and depth >= p.max_depth) or n < max(2, 2 * p.min_samples_leaf) or wt < 2 * least


def _below(t: float) -> np.float32:
    """The largest single-precision number up to ``t``: as a threshold of such numbers it is the same one."""
    near = np.float32(t)
    return np.nextafter(near, np.float32(-np.inf)) if near > t else near


def _gain(wl: np.ndarray, sl: np.ndarray, wt: float, st: float) -> np.ndarray:
    return sl * sl / wl + (st - sl) ** 2 / (wt - wl) - st * st / wt


class _Drawn:
    """A node of Extra-Trees: its own rows, a feature a row of ``x``, so that each pass reads one feature's values in place."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.x, self.y, self.w = x, y, w

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        return self.x.min(axis=1), self.x.max(axis=1)

    def best(self, feats: np.ndarray, lows: np.ndarray, highs: np.ndarray, mean: float, wt: float, p: ForestParams, least: float, rng: np.random.Generator):
        """(gain, feature, threshold) of the best of one uniform threshold a feature, or None."""
        low, high = lows[feats].astype(float), highs[feats].astype(float)
        t = low + (high - low) * rng.random(len(feats))
        t = np.where(t >= high, low, t)  # a threshold at the maximum splits nothing
        wy = self.w * (self.y - mean)
        nl, wl, sl = np.zeros(len(feats), np.int64), np.zeros(len(feats)), np.zeros(len(feats))
        for i, f in enumerate(feats):
            left = self.x[f] <= _below(t[i])
            nl[i] = np.count_nonzero(left)
            ones = left.astype(float)
            wl[i], sl[i] = self.w @ ones, wy @ ones
        ok = (nl >= p.min_samples_leaf) & (len(wy) - nl >= p.min_samples_leaf) & (wl >= least) & (wt - wl >= least) & (wl > 0) & (wt - wl > 0)
        if not ok.any():
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, _gain(wl, sl, wt, wy.sum()), -np.inf)
        k = int(np.argmax(gain))
        return gain[k], feats[k], t[k]

    def parts(self, feature: int, t: float) -> list[tuple[int, float, Callable[[], _Drawn]]]:
        """(rows, weight, the node) of both sides, left first; a node is made when it is asked for."""
        left = self.x[feature] <= _below(t)
        out = []
        for side in (left, ~left):
            rows = np.flatnonzero(side)
            w = self.w[rows]
            out.append((len(rows), float(w.sum()), lambda rows=rows, w=w: _Drawn(self.x.take(rows, axis=1), self.y[rows], w)))
        return out


class _Sorted:
    """A node of random forests: numbers of rows of the whole tree, and for each feature the same in the order of its values.

    A feature is sorted once for all trees; a node's order is its parent's without the other
    side's rows, which is what a stable sort of its own rows gives.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, orders: list[np.ndarray]) -> None:
        self.all, self.rows, self.orders = (x, y, w), rows, orders
        self.y, self.w = y[rows], w[rows]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        x = self.all[0]
        return np.array([x[f, o[0]] for f, o in enumerate(self.orders)]), np.array([x[f, o[-1]] for f, o in enumerate(self.orders)])

    def best(self, feats: np.ndarray, lows: np.ndarray, highs: np.ndarray, mean: float, wt: float, p: ForestParams, least: float, rng: np.random.Generator):
        """(gain, feature, threshold) of the best midpoint, or None; of equal gains the first row's, then the first feature's."""
        x, y, w = self.all
        n, st = len(self.rows), float((self.w * (self.y - mean)).sum())
        found = None
        for f in feats:
            o = self.orders[f]
            vals, ws = x[f].take(o), w.take(o)
            wl, sl = np.cumsum(ws), np.cumsum(ws * (y.take(o) - mean))
            # weights are positive, so wl rises: places that leave both sides enough are a range
            a = max(p.min_samples_leaf - 1, int(np.searchsorted(wl, least)), 0)
            b = min(n - max(p.min_samples_leaf, 1), n - 1 - int(np.searchsorted((wt - wl[n - 2 :: -1]), least))) if n > 1 else 0
            if a >= b:
                continue
            own = slice(a, b)
            ok = (vals[own] < vals[a + 1 : b + 1]) & (wl[own] > 0) & (wt - wl[own] > 0)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, _gain(wl[own], sl[own], wt, st), -np.inf)
            i = int(np.argmax(gain))
            if found is None or gain[i] > found[0] or (gain[i] == found[0] and a + i < found[1]):
                found = gain[i], a + i, f, float(vals[a + i]), float(vals[a + i + 1])
        if found is None:
            return None
        gain, _, f, low, high = found
        t = low / 2 + high / 2
        return gain, f, low if not low <= t < high else t

    def parts(self, feature: int, t: float) -> list[tuple[int, float, Callable[[], _Sorted]]]:
        """(rows, weight, the node) of both sides, left first; a node is made when it is asked for."""
        x, y, w = self.all
        below = x[feature] <= _below(t)
        side = below[self.rows]
        out = []
        for left in (True, False):
            rows = self.rows[side if left else ~side]
            out.append((len(rows), float(w[rows].sum()), lambda rows=rows, left=left: _Sorted(x, y, w, rows, [np.compress(below.take(o) == left, o) for o in self.orders])))
        return out


def orders(x: np.ndarray) -> list[np.ndarray]:
    """For each feature (a row of ``x``) the numbers of its values in ascending order, equal ones as they stand."""
    return [np.argsort(v, kind="stable") for v in x]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: ForestParams, rng: np.random.Generator, ordered: list[np.ndarray] | None = None) -> Tree:
    """One tree on rows of positive weight; ``ordered`` are the ``orders`` of the features, where they are known."""
    tree = Tree(np.zeros(x.shape[1]))
    root = float(w.sum())
    least = p.min_weight_fraction_leaf * root
    k = n_features(p.max_features, x.shape[1])
    x = np.ascontiguousarray(x.T)
    if p.method == "random-forest":
        first = _Sorted(x, y, w, np.arange(len(y)), orders(x) if ordered is None else ordered)
    else:
        first = _Drawn(x, y, w)
    stack = [(len(y), root, lambda: first, 0)]
    while stack:
        n, wt, make, depth = stack.pop()
        tree.nodes += 1
        tree.depth = max(tree.depth, depth)
        found = None
        if not _leaf(n, wt, depth, p, least):
            node = make()
            mean = float((node.w * node.y).sum()) / wt
            off = node.y - mean
            if float((node.w * off) @ off) / wt > np.finfo(float).eps:
                lows, highs = node.ranges()
                varied = np.flatnonzero(highs > lows)
                if len(varied):
                    feats = varied if len(varied) <= k else rng.choice(varied, k, replace=False)
                    found = node.best(feats, lows, highs, mean, wt, p, least, rng)
        if found is None:
            tree.leaves += 1
            continue
        gain, feature, t = found
        tree.importances[feature] += max(float(gain), 0.0) / root
        left, right = node.parts(feature, t)
        stack.append((*right, depth + 1))
        stack.append((*left, depth + 1))
    total = tree.importances.sum()
    if total > 0:
        tree.importances /= total
    return tree


def prefixes(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: ForestParams, seed: int, counts: tuple[int, ...]) -> Iterator[Forest]:
    """Ensembles of the first ``counts`` trees (ascending): a tree depends on its own number only, so each equals an independent fit."""
    some = w > 0
    x = np.asarray(x, np.float32).T
    x, y, w = np.ascontiguousarray(x if some.all() else x[:, some]), np.asarray(y[some], float), np.asarray(w[some], float)
    ordered = orders(x) if p.method == "random-forest" else None
    total, split, shapes, done = np.zeros(len(x)), 0, [], 0
    for count in counts:
        for i in range(done, count):
            rng = np.random.default_rng([seed, i])
            xs, ys, ws, own = x, y, w, ordered
            if p.resamples:
                drawn = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
                took = drawn > 0
                xs, ys, ws = x[:, took], y[took], w[took] * drawn[took]
                if ordered is not None:
                    place = np.cumsum(took) - 1
                    own = [place.take(np.compress(took.take(o), o)) for o in ordered]
            tree = grow(xs.T, ys, ws, p, rng, own)
            shapes.append((tree.nodes, tree.leaves, tree.depth))
            if tree.nodes > 1:
                total += tree.importances
                split += 1
        done = count
        mean = total / split if split else total
        norm = mean.sum()
        yield Forest(mean / norm if norm > 0 else mean.copy(), list(shapes))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: ForestParams, seed: int) -> Forest:
    """An ensemble of ``p.n_estimators`` trees."""
    return next(prefixes(x, y, w, p, seed, (p.n_estimators,)))


def shape_summary(shapes: list[tuple[int, int, int]]) -> dict[str, float]:
    """Total, mean, linear p50 and p95, and maximum of nodes, leaves and depth over the trees."""
    out: dict[str, float] = {}
    for name, values in zip(("nodes", "leaves", "depth"), np.array(shapes, float).T, strict=True):
        out |= {
            f"tree_{name}_total": float(values.sum()), f"tree_{name}_mean": float(values.mean()), f"tree_{name}_p50": float(np.percentile(values, 50)),
            f"tree_{name}_p95": float(np.percentile(values, 95)), f"tree_{name}_max": float(values.max()),
        }
    return out
