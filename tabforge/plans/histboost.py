"""Second-order gradient boosting on histograms, leaf-wise or with symmetric trees.

Every round grows one tree on the gradients of the loss. A split's gain is
GL**2 / (HL + l2) + GR**2 / (HR + l2) - G**2 / (H + l2), a leaf's value -G / (H + l2).

Leaf-wise growth always splits the leaf of the largest gain until ``leaves`` are there.
One pass over the rows serves all leaves that may be next: those that would be split if
their children were of no use are opened together, and the order is settled afterwards
from the true gains. So a tree takes about as many passes as it is deep, not as many as
it has leaves, and is the same as if leaves were opened one by one. Of two children only
the one with fewer rows is summed, the other is what is left of the parent.

A symmetric tree uses one split for all nodes of a level, the one of the largest sum of
gains.

Rows whose bins are no more than ``HELD_BYTES`` are held by one task that runs all rounds;
passes over so few would mostly wait for their jobs. Trees are the same either way.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from math import ceil, floor, log, log2

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.plans.base import Configured, setting
from tabforge.plans.histogram import (
    ROW_BITS, SUM_BITS, Grown, Held, Pass, bin_edges, histograms, pack_rows, plain_rows, rescored,
)
from tabforge.plans.trees import TreeModel, node_table

#: Rounds between two writes of the scores.
SETTLE_EVERY = 25
#: Bytes of all rows' bins up to which one task holds them and runs the rounds by itself.
HELD_BYTES = 1 << 25


class Split:
    def __init__(self, gain: float, feature: int, cut: int, left: np.ndarray, right: np.ndarray):
        self.gain, self.feature, self.cut, self.left, self.right = gain, feature, cut, left, right


class Gains:
    """Gains of all cuts of a node, from its sums."""

    def __init__(self, now: Pass, l2: float, min_rows: int, min_weight: float):
        self.now, self.l2, self.min_rows, self.min_weight = now, l2, min_rows, min_weight
        starts = now.offsets[:-1]
        sizes = np.diff(now.offsets)
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.bin = np.arange(int(now.offsets[-1])) - np.repeat(starts, sizes)
        self.last = self.bin == np.repeat(sizes, sizes) - 1
        self.starts = np.repeat(starts, sizes)

    def worth(self, sums: np.ndarray) -> np.ndarray:
        """G**2 / (H + l2) of exact sums (3 x ...); nought where there is nothing."""
        g, h = sums[0] / self.now.fineness[0], sums[1] / self.now.fineness[1] + self.l2
        return np.divide(g * g, h, out=np.zeros(np.shape(g)), where=h > 0)

    def lefts(self, sums: np.ndarray) -> np.ndarray:
        """Sums left of and at each bin."""
        through = np.cumsum(sums, axis=1)
        before = through[:, self.starts] - sums[:, self.starts]
        return through - before

    def of(self, sums: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gain of the cut behind each bin, sums left of it)."""
        left = self.lefts(sums)
        right = total[:, None] - left
        return self.worth(left) + self.worth(right) - float(self.worth(total)), left

    def allowed(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        right = total[:, None] - left
        use = np.zeros(len(self.now.width), dtype=bool)
        use[self.now.columns] = True
        good = use[self.feature] & ~self.last
        for side in (left, right):
            good &= (side[2] >= max(1, self.min_rows)) & (side[1] / self.now.fineness[1] >= self.min_weight)
        return good

    def best(self, sums: np.ndarray, total: np.ndarray) -> Split | None:
        """The split of the largest gain; ties to the first feature and the lowest cut."""
        if not sums.shape[1]:
            return None
        gain, left = self.of(sums, total)
        gain = np.where(self.allowed(left, total), gain, -np.inf)
        at = int(np.argmax(gain))
        if not gain[at] > 0:
            return None
        return Split(float(gain[at]), int(self.feature[at]), int(self.bin[at]), left[:, at], total - left[:, at])

    def value(self, total: np.ndarray) -> float:
        h = total[1] / self.now.fineness[1] + self.l2
        return float(-total[0] / self.now.fineness[0] / h) if h > 0 else 0.0


class _Node:
    """A node while the tree grows; ``path`` is 1 at the root, 2 p and 2 p + 1 below p."""

    def __init__(self, number: int, path: int, total: np.ndarray):
        self.number, self.path, self.total = number, path, total
        self.depth = path.bit_length() - 1
        self.sums: np.ndarray | None = None
        self.split: Split | None = None
        self.seen = False  # whether ``split`` is known
        self.children: tuple["_Node", "_Node"] | None = None


class LeafWise:
    """Best-first growth of one tree; ``ask`` sums up nodes."""

    def __init__(self, tree: Grown, gains: Gains, ask, leaves: int, depth: int | None):
        self.tree, self.gains, self.ask, self.leaves = tree, gains, ask, leaves
        self.depth = depth if depth is not None else 2**31

    def grow(self) -> tuple[Grown, list[Split]]:
        """The tree, and its splits in the order in which they were made."""
        root = _Node(self.tree.add(), 1, np.zeros(3, dtype=np.int64))
        root.sums = self.ask([root.number])[root.number]
        width = self.gains.now.width
        first = int(self.gains.now.columns[0]) if len(self.gains.now.columns) else 0
        low = int(self.gains.now.offsets[first])
        root.total = root.sums[:, low : low + width[first]].sum(axis=1) if width else root.total
        self._judge(root)
        while True:
            order, unknown = self._order(root)
            if not unknown:
                break
            self._open(unknown)
        return self._only(root, {n.path for n in order}), [n.split for n in order]

    def _judge(self, node: _Node) -> None:
        node.seen = True
        if node.depth < self.depth and node.sums is not None:
            node.split = self.gains.best(node.sums, node.total)

    def _order(self, root: _Node) -> tuple[list[_Node], list[_Node]]:
        """What is split in which order as far as gains are known, and whose children are not."""
        heap: list[tuple] = []
        if root.split:
            heappush(heap, (-root.split.gain, root.path, root))
        order: list[_Node] = []
        while heap and len(order) + 1 < self.leaves:
            node = heappop(heap)[2]
            order.append(node)
            if node.children is None:
                numbers = self.tree.split(node.number, node.split.feature, node.split.cut)
                totals = (node.split.left, node.split.right)
                node.children = tuple(_Node(k, 2 * node.path + s, t) for s, (k, t) in enumerate(zip(numbers, totals)))
                for child in node.children:
                    # Too few rows or too deep: known to be a leaf without asking.
                    if child.depth >= self.depth or child.total[2] < 2 * max(1, self.gains.min_rows):
                        child.seen = True
            for child in node.children:
                if child.split:
                    heappush(heap, (-child.split.gain, child.path, child))
        full = len(order) + 1 >= self.leaves
        parents = order[:-1] if full else order
        return order, [n for n in parents if not all(c.seen for c in n.children)]

    def _open(self, parents: list[_Node]) -> None:
        """Sum up the smaller child of each parent; the larger one is the rest."""
        asked = {min(n.children, key=lambda c: (c.total[2], c.number)).number: n for n in parents}
        sums = self.ask(list(asked))
        for number, parent in asked.items():
            small = next(c for c in parent.children if c.number == number)
            large = next(c for c in parent.children if c is not small)
            small.sums = sums[number]
            large.sums = parent.sums - small.sums
            parent.sums = None
            for child in parent.children:
                if not child.seen:
                    self._judge(child)

    def _only(self, root: _Node, paths: set[int]) -> Grown:
        """The tree of the splits that count, children behind their parents."""
        tree = Grown()
        waiting = [(root, tree.add())]
        for node, number in waiting:
            tree.value[number] = self.gains.value(node.total)
            if node.path in paths:
                waiting += zip(node.children, tree.split(number, node.split.feature, node.split.cut))
        return tree


def grow_symmetric(tree: Grown, gains: Gains, ask, depth: int) -> list[Split]:
    """One split per level for all nodes of it; returns the levels' splits with their summed gain."""
    level = [_Node(tree.add(), 1, np.zeros(3, dtype=np.int64))]
    level[0].sums = ask([0])[0]
    now = gains.now
    if now.width:
        low = int(now.offsets[int(now.columns[0])])
        level[0].total = level[0].sums[:, low : low + now.width[int(now.columns[0])]].sum(axis=1)
    nodes, splits = list(level), []
    use = np.zeros(len(now.width), dtype=bool)
    use[now.columns] = True
    for _ in range(depth):
        gain = sum(gains.of(n.sums, n.total)[0] for n in level)
        gain = np.where(use[gains.feature] & ~gains.last, gain, -np.inf)
        at = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or not gain[at] > 0:
            break
        split = Split(float(gain[at]), int(gains.feature[at]), int(gains.bin[at]), None, None)
        splits.append(split)
        below = []
        for node in level:
            left = gains.lefts(node.sums)[:, at]
            numbers = tree.split(node.number, split.feature, split.cut)
            totals = (left, node.total - left)
            node.children = tuple(_Node(k, 2 * node.path + s, t) for s, (k, t) in enumerate(zip(numbers, totals)))
            below += node.children
        if len(splits) < depth:
            small = {min(n.children, key=lambda c: (c.total[2], c.number)).number: n for n in level}
            wanted = [k for k, n in small.items() if min(c.total[2] for c in n.children) > 0]
            sums = ask(wanted) if wanted else {}
            for number, parent in small.items():
                for child in parent.children:
                    own = sums.get(number, np.zeros_like(parent.sums))
                    child.sums = own if child.number == number else parent.sums - own
        level = below
        nodes += below
    for node in nodes:
        tree.value[node.number] = gains.value(node.total)
    return splits


class Dealt:
    """Rows in blocks on the cluster: a pass per question, scores written every few rounds."""

    def __init__(self, now: Pass, blocks: DataFrame, n_blocks: int):
        self.now, self.blocks, self.n_blocks = now, blocks, n_blocks

    def begin(self) -> None:
        pass

    def ask(self, nodes: Sequence[int]) -> tuple[dict[int, np.ndarray], float]:
        return histograms(self.blocks, self.n_blocks, self.now, nodes)

    def add(self, tree: Grown, last: bool) -> None:
        self.now.written = [*self.now.written, tree]
        if len(self.now.written) == SETTLE_EVERY and not last:
            later = rescored(self.blocks, self.now).persist()
            self.blocks.unpersist()
            self.blocks, self.now.written = later, []


class Rounds:
    """The rounds of one fit, whoever adds up: blocks on the cluster (``Dealt``) or one task (``Held``)."""

    SETTINGS = ("rounds", "shape", "leaves", "depth", "l2", "min_rows", "min_weight", "rows_share", "columns_share", "seed")

    def __init__(self, settings: dict, now: Pass, n: int, most: float, heaviest: float):
        self.settings, self.now, self.most, self.heaviest = settings, now, most, heaviest
        self.bits = min(ROW_BITS, SUM_BITS - n.bit_length())

    def run(self, source: Dealt | Held) -> tuple[list[Grown], list[list[Split]]]:
        """All trees, and the splits of each in the order in which they were made."""
        own, now = self.settings, self.now
        trees, splits = [], []
        while len(trees) < own["rounds"]:
            now.fineness = (2.0 ** floor(self.bits - log2(self.most)), 2.0 ** floor(self.bits - log2(self.heaviest)))
            order, seen = self._round(source, len(trees))
            if seen > 2 * self.most:  # gradients outgrew their fineness: the round is done anew
                self.most = seen
                continue
            whole = own["rows_share"] >= 1 and own["columns_share"] >= 1
            if len(now.tree.feature) == 1 and whole:
                break
            trees.append(now.tree)
            splits.append(order)
            source.add(now.tree, len(trees) == own["rounds"])
        return trees, splits

    def _round(self, source: Dealt | Held, number: int) -> tuple[list[Split], float]:
        """Grow the round's tree into ``now.tree``; returns its splits and the largest gradient seen."""
        own, now = self.settings, self.now
        width, share = len(now.width), own["columns_share"]
        drawn = np.random.default_rng([own["seed"], number]).permutation(width)
        now.columns = np.sort(drawn[: max(1, ceil(share * width))]) if share < 1 else np.arange(width)
        now.share, now.seed = own["rows_share"], own["seed"] * 1_000_003 + number
        now.tree = Grown()
        source.begin()
        seen = 0.0

        def ask(nodes: list[int]) -> dict[int, np.ndarray]:
            nonlocal seen
            found, high = source.ask(nodes)
            seen = max(seen, high)
            return found

        gains = Gains(now, own["l2"], own["min_rows"], own["min_weight"])
        if own["shape"] == "symmetric":
            order = grow_symmetric(now.tree, gains, ask, own["depth"] or 6)
        else:
            now.tree, order = LeafWise(now.tree, gains, ask, own["leaves"], own["depth"]).grow()
        return order, seen


def _grown_in_task(rounds: Rounds, blocks: DataFrame) -> tuple[list[Grown], list[list[Split]]]:
    """The rounds in one task that holds all blocks; only trees come back."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, splits = rounds.run(Held(rounds.now, batches))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((trees, splits))], pa.binary())], ["grown"])

    return pickle.loads(blocks.coalesce(1).mapInArrow(grow, "grown binary").first()["grown"])


class HistBoost(Configured, Estimator):
    """Gradient boosting on binned features. Rows without a label are left out.

    A missing feature counts as smaller than all others. ``shape`` is 'leafwise' (with at
    most ``leaves`` leaves and, if given, ``depth`` levels) or 'symmetric' (``depth`` levels).
    Rows and columns of a round are sampled by hash of ``key`` (or of the row) and seed.
    Boosting ends early where not even the root can be split and nothing is sampled.
    """

    loss = setting("loss", "'squared' or 'logistic' (labels 0 and 1)")
    rounds = setting("rounds", "number of trees")
    step = setting("step", "learning rate")
    shape = setting("shape", "'leafwise' or 'symmetric'")
    leaves = setting("leaves", "leaves per tree, at most")
    depth = setting("depth", "levels per tree, at most")
    l2 = setting("l2", "penalty on leaf values")
    min_rows = setting("min_rows", "rows per leaf, at least")
    min_weight = setting("min_weight", "curvature per leaf, at least")
    bins = setting("bins", "bins per feature")
    rows_share = setting("rows_share", "share of rows per round")
    columns_share = setting("columns_share", "share of features per round")
    seed = setting("seed", "seed of the samples")
    key = setting("key", "row key that decides samples; none: the row itself")
    weight = setting("weight", "weight column, none: all alike")
    features = setting("features", "vector column")
    label = setting("label", "label column")
    defaults = {
        "loss": "squared", "rounds": 100, "step": 0.1, "shape": "leafwise", "leaves": 31, "depth": None, "l2": 0.0,
        "min_rows": 20, "min_weight": 0.0, "bins": 255, "rows_share": 1.0, "columns_share": 1.0, "seed": 42, "key": None,
        "weight": None, "features": "features", "label": "label",
    }

    def _start(self, mean: float) -> float:
        if self.get("loss") == "squared":
            return mean
        mean = min(max(mean, 1e-12), 1 - 1e-12)
        return log(mean / (1 - mean))

    def _fit(self, df: DataFrame) -> TreeModel:
        rows = plain_rows(df, self.get("features"), self.get("label"), self.get("weight"), self.get("key"))
        w = F.col("weight")
        facts = rows.agg(
            F.count("*"), F.sum(w * F.col("label")) / F.sum(w), F.min("label"), F.max("label"), F.max("weight"),
        ).first()
        n, mean, low, high, heaviest = facts
        kind = "logit" if self.get("loss") == "logistic" else "value"
        spark = df.sparkSession
        if not n:
            return self._model(spark, kind, 0.0, [], [], [])
        start = self._start(mean)
        edges = bin_edges(rows.select("x"), self.get("bins"))
        blocks = pack_rows(rows, n, edges, start).persist()
        n_blocks = blocks.count()
        now = Pass(edges, self.get("loss"), self.get("step"))
        heaviest = heaviest or 1.0
        most = (1.0 if kind == "logit" else max(high - start, start - low) or 1.0) * heaviest
        bits = min(ROW_BITS, SUM_BITS - int(n).bit_length())
        settings = {name: self.get(name) for name in Rounds.SETTINGS}
        rounds = Rounds(settings, now, int(n), most, heaviest)
        if n * (len(edges) + 32) <= HELD_BYTES:
            trees, splits = _grown_in_task(rounds, blocks)
            blocks.unpersist()
        else:
            source = Dealt(now, blocks, n_blocks)
            trees, splits = rounds.run(source)
            source.blocks.unpersist()
        return self._model(spark, kind, start, trees, edges, splits)

    def _model(self, spark, kind, start, trees, edges, splits) -> TreeModel:
        nodes = [row for k, tree in enumerate(trees) for row in tree.rows(k, edges, self.get("step"))]
        model = TreeModel(
            tables={"nodes": node_table(spark, nodes)}, kind=kind, start=float(start), features=self.get("features")
        )
        #: (feature, threshold, gain) of each tree's splits in order, for looking at; not saved.
        model.splits = [[(s.feature, float(edges[s.feature][s.cut]), s.gain) for s in order] for order in splits]
        return model
