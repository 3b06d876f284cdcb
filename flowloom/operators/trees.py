"""Histogram trees of bounded training samples: a bagged forest and soft-max boosting, in NumPy.

Trees of any depth on a sample of bounded size take seconds in one process, where a distributed fit takes a job for
every level of every tree. So the sample is sent to the tasks once, the forest's trees are grown in parallel, and all
rows are scored in Arrow batches. Ties go to the first feature and the lowest threshold; the seed fixes all draws.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64
NODES_AT_ONCE = 256


def thresholds(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: between different values, at even parts of the rows."""
    out = []
    for c in x.T:
        seen = np.unique(c)
        if len(seen) > bins:
            seen = np.unique(np.quantile(c, np.linspace(0, 1, bins), method="lower"))
        out.append((seen[:-1] + seen[1:]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


@dataclass
class Tree:
    """Nodes in arrays; leaves have feature -1. `value` has a row a node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def steps(self, xb: np.ndarray):
        """Node numbers of all rows, level by level, until every row is in its leaf."""
        rows, node = np.arange(len(xb)), np.zeros(len(xb), dtype=np.int32)
        yield node
        while (open_ := self.feature[node] >= 0).any():
            f = self.feature[node]
            right = xb[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(open_, self.left[node] + right, node)
            yield node

    def leaf(self, xb: np.ndarray) -> np.ndarray:
        for node in self.steps(xb):
            pass
        return node

    def attribute(self, xb: np.ndarray, out: np.ndarray) -> None:
        """Adds to out (rows, features, values) what each split on a row's path changed."""
        rows, before = np.arange(len(xb)), None
        for node in self.steps(xb):
            if before is not None:
                moved = np.flatnonzero(node != before)
                out[rows[moved], self.feature[before[moved]]] += self.value[node[moved]] - self.value[before[moved]]
            before = node


class _Growing:
    """The node arrays of a tree that grows level by level; the two children of a node stand side by side."""

    def __init__(self, root: np.ndarray):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [root]

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray) -> int:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for v in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)
        return at

    def done(self) -> Tree:
        return Tree(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32), np.array(self.value, np.float32))


def _best_gini(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node: gain, feature place and bin of the best split; hist (nodes, features, bins, classes)."""
    left = hist.cumsum(axis=2)
    right = left[:, :, -1:, :] - left
    nl, nr = left.sum(axis=3), right.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left**2).sum(axis=3) / nl + (right**2).sum(axis=3) / nr
    whole = left[:, :1, -1, :]
    score = np.where((nl > 1e-12) & (nr > 1e-9 * nl), score - ((whole**2).sum(axis=2) / whole.sum(axis=2))[:, :, None], -np.inf)
    flat = score.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(hist)), best], best // hist.shape[2], best % hist.shape[2]


def grow_class_tree(xb: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, tried: int, rng: np.random.Generator) -> Tree:
    """A tree on rows with weights; at each node `tried` random features, all of them where none of those splits."""
    keep = np.flatnonzero(weight > 0)
    xb, y, weight = xb[keep], y[keep], weight[keep]
    m = xb.shape[1]
    share = lambda h: h / max(h.sum(), 1e-300)
    root = np.bincount(y, weight, minlength=classes)
    tree = _Growing(share(root))
    at, level = np.zeros(len(y), dtype=np.int64), [0] if np.count_nonzero(root) > 1 and m else []
    for _ in range(depth):
        nxt = []
        for lo in range(0, len(level), NODES_AT_ONCE):
            nodes = np.array(level[lo : lo + NODES_AT_ONCE])
            for width in (tried, m):
                if not len(nodes):
                    break
                place = np.full(len(tree.feature), -1, dtype=np.int64)
                place[nodes] = np.arange(len(nodes))
                rows = np.flatnonzero(place[at] >= 0)
                who = place[at[rows]]
                feats = rng.random((len(nodes), m)).argsort(axis=1)[:, :width] if width < m else np.broadcast_to(np.arange(m), (len(nodes), m))
                bins = xb[rows[:, None], feats[who]].astype(np.int64)
                index = (((who[:, None] * width + np.arange(width)) * BINS) + bins) * classes + y[rows][:, None]
                hist = np.bincount(index.ravel(), np.repeat(weight[rows], width), minlength=len(nodes) * width * BINS * classes).reshape(len(nodes), width, BINS, classes)
                gain, f, b = _best_gini(hist)
                good = np.isfinite(gain) & (gain > 1e-12)
                for j in np.flatnonzero(good):
                    part = hist[j, f[j]]
                    left, right = part[: b[j] + 1].sum(axis=0), part[b[j] + 1 :].sum(axis=0)
                    child = tree.split(int(nodes[j]), int(feats[j, f[j]]), int(b[j]), share(left), share(right))
                    nxt += [child + i for i, h in enumerate((left, right)) if np.count_nonzero(h > 1e-12) > 1]
                chosen = good[who]
                r, j = rows[chosen], who[chosen]
                at[r] = np.array(tree.left)[nodes[j]] + (xb[r, feats[j, f[j]]] > b[j])
                if width == m:
                    break
                nodes = nodes[~good]
        level = nxt
        if not level:
            break
    return tree.done()


def grow_gradient_tree(xb: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0, least: float = 1.0) -> tuple[Tree, np.ndarray]:
    """A regression tree on gradients, and the leaf of each row; both children of a split have a Hessian of `least`."""
    m = xb.shape[1]
    score = lambda a, b: -a / (b + ridge)
    tree = _Growing(np.array([score(g.sum(), h.sum())]))
    at, level = np.zeros(len(g), dtype=np.int64), [0] if h.sum() >= 2 * least and m else []
    columns = np.arange(m, dtype=np.int64) * BINS
    for _ in range(depth):
        if not level:
            break
        nodes = np.array(level)
        place = np.full(len(tree.feature), -1, dtype=np.int64)
        place[nodes] = np.arange(len(nodes))
        rows = np.flatnonzero(place[at] >= 0)
        who = place[at[rows]]
        index = ((who * (m * BINS))[:, None] + columns + xb[rows]).ravel()
        shape = (len(nodes), m, BINS)
        lg = np.bincount(index, np.repeat(g[rows], m), minlength=len(nodes) * m * BINS).reshape(shape).cumsum(axis=2)
        lh = np.bincount(index, np.repeat(h[rows], m), minlength=len(nodes) * m * BINS).reshape(shape).cumsum(axis=2)
        tg, th = lg[:, :1, -1:], lh[:, :1, -1:]
        gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
        gain = np.where((lh >= least) & (th - lh >= least), gain, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        good = gain[np.arange(len(nodes)), best] > 1e-6
        f, b = best // BINS, best % BINS
        level = []
        for j in np.flatnonzero(good):
            a, c = lg[j, f[j], b[j]], lh[j, f[j], b[j]]
            child = tree.split(int(nodes[j]), int(f[j]), int(b[j]), np.array([score(a, c)]), np.array([score(tg[j, 0, 0] - a, th[j, 0, 0] - c)]))
            level += [child + i for i, s in enumerate((c, th[j, 0, 0] - c)) if s >= 2 * least]
        chosen = good[who]
        r, j = rows[chosen], who[chosen]
        at[r] = np.array(tree.left)[nodes[j]] + (xb[r, f[j]] > b[j])
    return tree.done(), at


@dataclass
class ForestModel:
    """Mean of the trees' class shares."""

    cuts: list[np.ndarray]
    classes: int
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        xb, out = binned(x, self.cuts), np.zeros((len(x), self.classes))
        for t in self.trees:
            out += t.value[t.leaf(xb)]
        return out / max(1, len(self.trees))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, classes): with the trees' mean root they add up to the prediction."""
        xb, out = binned(x, self.cuts), np.zeros((len(x), x.shape[1], self.classes))
        for t in self.trees:
            t.attribute(xb, out)
        return out / max(1, len(self.trees))


@dataclass
class BoostedModel:
    """Soft-max of the classes' summed trees."""

    cuts: list[np.ndarray]
    classes: int
    step: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        xb, out = binned(x, self.cuts), np.zeros((len(x), self.classes))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += self.step * (t.value[t.leaf(xb), 0] if len(t.feature) > 1 else t.value[0, 0])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, classes) of the margins."""
        xb, out = binned(x, self.cuts), np.zeros((len(x), x.shape[1], self.classes))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                if len(t.feature) > 1:
                    part = np.zeros((len(x), x.shape[1], 1))
                    t.attribute(xb, part)
                    out[:, :, k] += self.step * part[:, :, 0]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grow_forest_tree(xb: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, seed: int, number: int) -> Tree:
    """Tree `number` of a forest: a bootstrap of the rows, the root of the features' number tried at each node."""
    rng = np.random.default_rng([seed, number])
    drawn = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) if len(y) else np.zeros(0)
    return grow_class_tree(xb, y, weight * drawn, classes, depth, max(1, int(np.sqrt(xb.shape[1]))), rng)


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rounds: int, depth: int, step: float) -> BoostedModel:
    cuts = thresholds(x)
    xb, model = binned(x, cuts), BoostedModel(cuts, classes, step)
    z, truth = np.zeros((len(y), classes)), np.eye(classes)[y] if classes else np.zeros((len(y), 0))
    for _ in range(rounds):
        p = softmax(z)
        g, h = (p - truth) * weight[:, None], np.maximum(2 * p * (1 - p) * weight[:, None], 1e-16)
        trees = []
        for k in range(classes):
            tree, at = grow_gradient_tree(xb, g[:, k], h[:, k], depth)
            z[:, k] += step * tree.value[at, 0]
            trees.append(tree)
        model.rounds.append(trees)
    return model
