"""Extremely randomised trees (Geurts, Ernst and Wehenkel 2006), grown level by level.

All rows take part in every tree. At a node features are drawn until ``tried`` of them
vary there; each gets one threshold, uniform between the node's least and greatest value,
and the best of these cuts by Gini impurity is made. Two passes serve one level of many
trees: one finds the ranges and class counts of all open nodes, one the class counts
left of the drawn cuts. Draws depend on the seed, the tree and the place of the node, so
the trees do not depend on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.plans.base import Configured, setting
from tabforge.plans.histogram import LEAF, plain_rows
from tabforge.plans.rowblocks import HELD_BYTES, Arrays, Held, gathered, in_task, raw_blocks
from tabforge.plans.trees import TreeModel, column_table

#: Bytes of one tree's ranges at its widest level times the trees grown together, at most.
PASS_BYTES = 1 << 26
#: Tasks that hold all rows and grow a share of the trees each, at most.
MOST_TASKS = 16


class _Tree:
    """Nodes of a growing tree; ``path`` is 1 at the root, 2 p and 2 p + 1 below p."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.path, self.counts = [], [], [], [], [], []
        self.spots: dict[int, np.ndarray] = {}  # where the rows of a block were placed last
        self.open = [self.add(1)]

    def add(self, path: int) -> int:
        for of, empty in ((self.feature, LEAF), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.path, path), (self.counts, None)):
            of.append(empty)
        return len(self.path) - 1

    def place(self, x: np.ndarray, block: int) -> np.ndarray:
        feature, left, right = (np.array(a, dtype=np.int32) for a in (self.feature, self.left, self.right))
        threshold = np.array(self.threshold)
        at, rows = self.spots.get(block), np.arange(len(x))
        at = np.zeros(len(x), dtype=np.int32) if at is None else at
        while (inner := feature[at] != LEAF).any():
            high = x[rows, np.where(inner, feature[at], 0)] > threshold[at]
            at = np.where(inner, np.where(high, right[at], left[at]), at)
        self.spots[block] = at
        return at

    def slots(self, x: np.ndarray, block: int) -> np.ndarray:
        """The number of the open node that each row of a block is in, or -1.

        Rows go on from where they were: nodes split, but never close again.
        """
        slot = np.full(len(self.path), -1, dtype=np.int16 if len(self.open) < 1 << 15 else np.int64)
        slot[self.open] = np.arange(len(self.open))
        return slot[self.place(x, block)]

    def columns(self, number: int, classes: int) -> list[np.ndarray]:
        """Columns of the node table: inner nodes have no shares, leaves those of their rows."""
        n = len(self.feature)
        counts = np.array(self.counts, dtype=float).reshape(n, classes)
        shares = counts / counts.sum(axis=1, keepdims=True)
        shares[np.array(self.feature) != LEAF] = 0.0
        own = (self.feature, self.left, self.right)
        feature, left, right = (np.array(a, dtype=np.int32) for a in own)
        return [np.full(n, number, dtype=np.int32), np.arange(n, dtype=np.int32), feature, np.array(self.threshold, dtype=float), left, right, shares]


def _ranges(trees: dict[int, _Tree], classes: int, width: int):
    """Least and greatest value of every feature, and rows of each class, in each open node."""

    def add_up(blocks: Iterator[Arrays]) -> Iterator[tuple[int, list[np.ndarray]]]:
        found = {}
        for block, (x, label, _, _) in enumerate(blocks):
            for key, tree in trees.items():
                if key not in found:
                    n = len(tree.open)
                    found[key] = [np.full((n, width), np.inf), np.full((n, width), -np.inf), np.zeros((n, classes), dtype=np.int64)]
                low, high, counts = found[key]
                slot = tree.slots(x, block)
                order = np.argsort(slot, kind="stable")
                order = order[np.searchsorted(slot[order], 0) :]
                if not len(order):
                    continue
                ordered, sorted_x = slot[order].astype(np.int64), x[order]
                starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                at = ordered[starts]
                low[at] = np.minimum(low[at], np.minimum.reduceat(sorted_x, starts, axis=0))
                high[at] = np.maximum(high[at], np.maximum.reduceat(sorted_x, starts, axis=0))
                counts += np.bincount(ordered * classes + label[order].astype(np.int64), minlength=counts.size).reshape(counts.shape)
        yield from found.items()

    return add_up


def _cut_counts(trees: dict[int, _Tree], cuts: dict[int, tuple[np.ndarray, np.ndarray]], classes: int):
    """Rows of each class at or below each drawn threshold of each open node."""

    def add_up(blocks: Iterator[Arrays]) -> Iterator[tuple[int, list[np.ndarray]]]:
        found = {}
        for block, (x, label, _, _) in enumerate(blocks):
            for key, tree in trees.items():
                feature, threshold = cuts[key]
                counts = found.setdefault(key, [np.zeros(feature.size * classes, dtype=np.int64)])
                slot = tree.slots(x, block)
                rows = np.flatnonzero(slot >= 0)
                slot = slot[rows].astype(np.int64)
                low = x[rows[:, None], feature[slot]] <= threshold[slot]
                code = (slot[:, None] * feature.shape[1] + np.arange(feature.shape[1])) * classes + label[rows].astype(np.int64)[:, None]
                counts[0] = counts[0] + np.bincount(code[low], minlength=len(counts[0]))
        yield from found.items()

    return add_up


def drawn_cuts(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray, tried: int) -> tuple[list[int], list[float]]:
    """Features in drawn order that vary in the node, at most ``tried``, each with its threshold.

    A threshold is at least the least and below the greatest value, so that both sides have rows.
    """
    random = np.random.default_rng([seed, tree, path])
    features, thresholds = [], []
    for f in random.permutation(len(low)).tolist():
        if len(features) == tried:
            break
        if high[f] > low[f]:
            chance = float(random.random())
            cut = float(low[f] + (high[f] - low[f]) * chance)
            features.append(f)
            thresholds.append(float(low[f]) if not low[f] <= cut < high[f] else cut)
    return features, thresholds


def impurity(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity; classes along the last axis."""
    n = counts.sum(axis=-1)
    return n - np.divide((counts.astype(float) ** 2).sum(axis=-1), n, out=np.zeros(np.shape(n)), where=n > 0)


class ExtraTrees(Configured, Estimator):
    """A classifier; probabilities are the mean of the leaves' class shares.

    Rows without a label are left out. Missing features are not allowed.
    """

    trees = setting("trees", "number of trees")
    depth = setting("depth", "levels per tree, at most")
    tried = setting("tried", "features tried per node; none: the square root of all")
    min_rows = setting("min_rows", "rows per leaf, at least")
    classes = setting("classes", "number of classes; none: the greatest label and one")
    seed = setting("seed", "seed of features and thresholds")
    features = setting("features", "vector column")
    label = setting("label", "label column, 0 .. classes - 1")
    defaults = {
        "trees": 300, "depth": 10, "tried": None, "min_rows": 1, "classes": None, "seed": 42, "features": "features", "label": "label",
    }

    def _fit(self, df: DataFrame) -> TreeModel:
        rows = plain_rows(df, self.get("features"), self.get("label"), None, None)
        n, top, width = rows.agg(F.count("*"), F.max("label"), F.max(F.size("x"))).first()
        classes = self.get("classes") or int(top or 0) + 1
        nodes: list[list[np.ndarray]] = []
        if n:
            blocks = raw_blocks(rows, n, width).persist()
            n_blocks = blocks.count()
            if n * (8 * width + 24) <= HELD_BYTES:
                # Every task holds all rows and grows a share of the trees.
                tasks = min(self.get("trees"), df.sparkSession.sparkContext.defaultParallelism, MOST_TASKS)
                dealt = [range(first, self.get("trees"), tasks) for first in range(tasks)]
                pool = ThreadPool(max(1, tasks))
                try:
                    work = inheritable_thread_target(df.sparkSession)(lambda own: in_task(blocks, lambda held: self._together(held.joined(), 1, own, classes, width, n)))
                    nodes = [columns for part in pool.map(work, dealt) for columns in part]
                finally:
                    pool.close()
            else:
                nodes = self._together(blocks, n_blocks, range(self.get("trees")), classes, width, n)
            blocks.unpersist()
        return TreeModel(tables={"nodes": column_table(df.sparkSession, nodes)}, kind="votes", features=self.get("features"))

    def _together(self, blocks: DataFrame | Held, n_blocks: int, numbers: Sequence[int], classes: int, width: int, n: int) -> list[list[np.ndarray]]:
        """Node columns of the trees, as many grown at a time as ``PASS_BYTES`` allows."""
        widest = max(1, min(2 ** max(0, self.get("depth") - 1), n // max(1, self.get("min_rows"))))
        together = max(1, PASS_BYTES // (widest * (16 * width + 8 * classes)))
        parts = [list(numbers[first : first + together]) for first in range(0, len(numbers), together)]
        return [columns for part in parts for columns in self._grow(blocks, n_blocks, part, classes, width)]

    def _grow(self, blocks: DataFrame | Held, n_blocks: int, numbers: list[int], classes: int, width: int) -> Iterator[list[np.ndarray]]:
        tried = min(width, self.get("tried") or max(1, int(sqrt(width))))
        trees = {k: _Tree() for k in numbers}
        for level in range(self.get("depth") + 1):
            growing = {k: t for k, t in trees.items() if t.open}
            if not growing:
                break
            found = gathered(blocks, n_blocks, _ranges(growing, classes, width), ["min", "max", "sum"], ["float64", "float64", "int64"], size=(16 * width + 8 * classes) * sum(len(t.open) for t in growing.values()))
            cuts = {k: self._draw(k, t, *found[k], classes, width, tried, level) for k, t in growing.items()}
            growing = {k: t for k, t in growing.items() if t.open}
            if not growing:
                break
            left = gathered(blocks, n_blocks, _cut_counts(growing, cuts, classes), ["sum"], ["int64"], size=sum(8 * classes * cuts[k][0].size for k in growing))
            for k, tree in growing.items():
                self._split(tree, *cuts[k], left[k][0].reshape(*cuts[k][0].shape, classes))
        for k, tree in trees.items():
            yield tree.columns(k, classes)

    def _draw(self, number: int, tree: _Tree, low, high, counts, classes: int, width: int, tried: int, level: int):
        """Note the classes of the open nodes, close those that stay leaves, draw cuts for the others."""
        low, high, counts = low.reshape(-1, width), high.reshape(-1, width), counts.reshape(-1, classes)
        still, features, thresholds = [], [], []
        many = (counts.sum(axis=1) >= 2 * max(1, self.get("min_rows"))) & ((counts > 0).sum(axis=1) > 1)
        for slot, node in enumerate(tree.open):
            tree.counts[node] = counts[slot]
            if level >= self.get("depth") or not many[slot]:
                continue
            own = drawn_cuts(self.get("seed"), number, tree.path[node], low[slot], high[slot], tried)
            if own[0]:
                still.append(node)
                pad = tried - len(own[0])  # repeated cuts change nothing
                features.append(own[0] + own[0][-1:] * pad)
                thresholds.append(own[1] + own[1][-1:] * pad)
        tree.open = still
        return np.array(features, dtype=np.int64).reshape(-1, tried), np.array(thresholds).reshape(-1, tried)

    def _split(self, tree: _Tree, features, thresholds, left) -> None:
        below = []
        right = np.array([tree.counts[node] for node in tree.open])[:, None] - left
        rest = impurity(left) + impurity(right)
        fits = np.minimum(left.sum(axis=2), right.sum(axis=2)) >= max(1, self.get("min_rows"))
        rest = np.where(fits, rest, np.inf)
        best = np.argmin(rest, axis=1)
        for slot, node in enumerate(tree.open):
            at = best[slot]
            if not np.isfinite(rest[slot, at]):
                continue
            tree.feature[node], tree.threshold[node] = int(features[slot, at]), float(thresholds[slot, at])
            tree.left[node], tree.right[node] = tree.add(2 * tree.path[node]), tree.add(2 * tree.path[node] + 1)
            below += [tree.left[node], tree.right[node]]
        tree.open = below
