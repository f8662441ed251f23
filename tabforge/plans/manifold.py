"""Cluster numbers and principal components as features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.plans.base import Configured, setting
from tabforge.plans.histogram import uniform
from tabforge.plans.rowblocks import Arrays, gathered, raw_blocks


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre, column by column."""
    out = np.zeros((len(x), len(centres)))
    for c in range(x.shape[1]):
        out += (x[:, c : c + 1] - centres[:, c]) ** 2
    return out


def _smaller_first(width: int):
    """Merge rows of numbers by the smaller first one."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, width), b.reshape(-1, width)
        return np.where(b[:, :1] < a[:, :1], b, a).ravel()

    return merge


class ClusterId(Configured, Estimator):
    """k-means; the cheapest of several seeded runs wins. Adds ``cluster_id``.

    All runs go on side by side, so one pass serves one round of all of them. Centres are
    drawn as k-means++ does: a row's chance grows with its squared distance to the centres
    so far; every row draws a waiting time from its hash and the first one is taken. Sums
    are of whole numbers of a fixed fineness, so runs do not depend on the order of rows.
    """

    cols = setting("cols", "gap-free numeric columns")
    k = setting("k", "number of clusters")
    seed = setting("seed", "seed of the first run")
    restarts = setting("restarts", "number of runs")
    max_iter = setting("max_iter", "rounds per run, at most")
    defaults = {"k": 12, "seed": 42, "restarts": 10, "max_iter": 100}

    def _fit(self, df: DataFrame) -> "ClusterIdModel":
        cols = self.get("cols")
        values = [F.col(c).cast("double") for c in cols]
        rows = df.select(
            F.array(*values).alias("x"), F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"), F.xxhash64(*values).alias("mark")
        )
        n, *highs = rows.agg(F.count("*"), *[F.max(F.abs(F.col("x")[k])) for k in range(len(cols))]).first()
        if not n:
            return ClusterIdModel(cols=cols, centres=[], cost=0.0)
        blocks = raw_blocks(rows, n, len(cols)).persist()
        n_blocks = blocks.count()
        runs = self._drawn(blocks, n_blocks)
        bits = min(40, 61 - int(n).bit_length())
        fine = np.array([2.0 ** (bits - int(np.ceil(np.log2(h)))) if h else 1.0 for h in highs])
        costs = {}
        going = set(range(len(runs)))
        for _ in range(self.get("max_iter") + 1):
            found = self._round(blocks, n_blocks, {r: runs[r] for r in sorted(going)}, fine)
            for r, (sums, counts, cost) in found.items():
                costs[r] = float(f"{cost[0]:.12g}")
                sums, old = sums.reshape(runs[r].shape), runs[r]
                mean = sums / fine / np.maximum(counts, 1)[:, None]
                new = np.where(counts[:, None] > 0, mean, old)  # a centre without rows stays
                if np.allclose(new, old, rtol=1e-9, atol=0.5 / fine.max()):
                    going.discard(r)
                runs[r] = new
            if not going:
                break
        blocks.unpersist()
        best = min(range(len(runs)), key=lambda r: (costs[r], r))
        return ClusterIdModel(cols=cols, centres=runs[best].tolist(), cost=costs[best])

    def _drawn(self, blocks: DataFrame, n_blocks: int) -> list[np.ndarray]:
        """First centres of every run; fewer than k if there are fewer different rows."""
        width, seed = len(self.get("cols")), self.get("seed")
        runs = [np.zeros((0, width)) for _ in range(self.get("restarts"))]
        for step in range(self.get("k")):

            def draw(found: Iterator[Arrays]) -> Iterator[tuple[int, list[np.ndarray]]]:
                first = np.full((len(runs), 1 + width), np.inf)
                for x, _, _, mark in found:
                    for r, centres in enumerate(runs):
                        far = _squared(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                        chance = uniform(mark, (seed + r) * 1_000_003 + step)
                        wait = np.divide(-np.log(chance), far, out=np.full(len(x), np.inf), where=far > 0)
                        at = int(np.argmin(wait)) if len(x) else -1
                        if at >= 0 and wait[at] < first[r, 0]:
                            first[r] = [wait[at], *x[at]]
                yield 0, [first]

            taken = gathered(blocks, n_blocks, draw, [_smaller_first(1 + width)], ["float64"])[0][0].reshape(-1, 1 + width)
            runs = [np.vstack([c, row[1:]]) if np.isfinite(row[0]) else c for c, row in zip(runs, taken)]
        return runs

    def _round(self, blocks: DataFrame, n_blocks: int, runs: dict[int, np.ndarray], fine: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Sums, rows and cost of each centre's rows, for each run."""

        def add_up(found: Iterator[Arrays]) -> Iterator[tuple[int, list[np.ndarray]]]:
            totals = {r: [np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64), np.zeros(1)] for r, c in runs.items()}
            for x, *_ in found:
                whole = np.rint(x * fine).astype(np.int64)
                for r, centres in runs.items():
                    far = _squared(x, centres)
                    near = far.argmin(axis=1)
                    np.add.at(totals[r][0], near, whole)
                    totals[r][1] += np.bincount(near, minlength=len(centres))
                    totals[r][2] += far.min(axis=1).sum()
            yield from totals.items()

        return gathered(blocks, n_blocks, add_up, ["sum"] * 3, ["int64", "int64", "float64"])


class ClusterIdModel(Configured, Model):
    cols = setting("cols", "columns in the order of the centres")
    centres = setting("centres", "one list of numbers per cluster")
    cost = setting("cost", "sum of squared distances of the fitted rows")

    def _transform(self, df: DataFrame) -> DataFrame:
        def squared(centre):
            parts = [(F.col(c) - x) * (F.col(c) - x) for c, x in zip(self.get("cols"), centre)]
            return reduce(add, parts)

        if not self.get("centres"):
            return df.withColumn("cluster_id", F.lit(None).cast("int"))
        distances = F.array(*[squared(centre) for centre in self.get("centres")])
        nearest = F.array_position(distances, F.array_min(distances)) - 1
        return df.withColumn("cluster_id", nearest.cast("int"))


class PcaFeatures(Configured, Estimator):
    """Principal components of the centred columns as ``pca_1 .. pca_k``.

    The sign is fixed: the largest loading of each component is positive.
    """

    cols = setting("cols", "gap-free numeric columns")
    k = setting("k", "number of components")
    defaults = {"k": 2}

    def _fit(self, df: DataFrame) -> "PcaModel":
        cols = self.get("cols")
        means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
        centred = df.select(*[(F.col(c) - means[c]).alias(c) for c in cols])
        matrix = VectorAssembler(inputCols=cols, outputCol="_matrix").transform(centred)
        fitted = PCA(k=self.get("k"), inputCol="_matrix", outputCol="_pca").fit(matrix)
        loadings = fitted.pc.toArray().T
        largest = np.abs(loadings).argmax(axis=1)
        signs = np.sign(loadings[np.arange(len(loadings)), largest])
        return PcaModel(
            means=means,
            components=(loadings * signs[:, None]).tolist(),
            explained=fitted.explainedVariance.toArray().tolist(),
        )


class PcaModel(Configured, Model):
    means = setting("means", "mean per column, in column order")
    components = setting("components", "loadings, one list per component")
    explained = setting("explained", "share of the variance per component")

    def _transform(self, df: DataFrame) -> DataFrame:
        means = self.get("means")
        centred = [F.col(c) - mean for c, mean in means.items()]
        return df.withColumns(
            {
                f"pca_{i}": reduce(add, [x * w for x, w in zip(centred, loadings)])
                for i, loadings in enumerate(self.get("components"), start=1)
            }
        )
