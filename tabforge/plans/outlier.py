"""Isolation forest (Liu, Ting and Zhou 2008) and training on the rows it keeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.quantiles import fitted_quantiles
from tabforge.plans.base import RAW, Configured, packed, setting

NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"


def unsuccessful_search(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(cols: list[str], seed: int):
    """Grow one tree from its sample; at most 2 x sample rows of nodes come out."""

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        values = sample.sort_values("row_id")[cols].to_numpy(dtype=float)
        limit = int(np.ceil(np.log2(max(2, len(values)))))
        random = np.random.default_rng([seed, tree])
        nodes, waiting = [], [(np.arange(len(values)), 0, -1, 0)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][4 + side] = number
            low, high = values[rows].min(axis=0), values[rows].max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(splittable):
                nodes.append([tree, number, -1, 0.0, -1, -1,
                              depth + unsuccessful_search(len(rows))])
                continue
            feature = int(random.choice(splittable))
            threshold = float(random.uniform(low[feature], high[feature]))
            nodes.append([tree, number, feature, threshold, -1, -1, 0.0])
            goes_left = values[rows, feature] <= threshold
            waiting.append((rows[~goes_left], depth + 1, number, 1))
            waiting.append((rows[goes_left], depth + 1, number, 0))
        return pd.DataFrame(nodes, columns=[part.split()[0] for part in NODES.split(", ")])

    return grow


class _ForestSettings(Configured):
    cols = setting("cols", "gap-free numeric columns")


class IsolationForest(_ForestSettings, Estimator):
    """Rows that random splits isolate early are outliers.

    Each tree is grown in its own group from the ``sample`` rows whose hash for this tree
    is smallest, so every row may enter any tree. Scores and their threshold are computed
    over all rows. Adds ``anomaly_score`` and ``is_outlier``.
    """

    id_col = setting("id_col", "row key, decides the sample")
    trees = setting("trees", "number of trees")
    sample = setting("sample", "rows per tree")
    contamination = setting("contamination", "share of rows called outliers")
    seed = setting("seed", "seed of sample and splits")
    defaults = {"trees": 100, "sample": 256, "contamination": 0.02, "seed": 42}

    def samples(self, df: DataFrame, n: int) -> DataFrame:
        """(tree, row_id, columns) of every tree's sample of the n rows.

        One pass draws a number for each row and tree; only those below a ceiling that
        leaves about twice the sample of each tree go on to be ranked.
        """
        trees, sample, seed = self.get("trees"), self.get("sample"), F.lit(self.get("seed"))
        share = min(1.0, (2 * sample + 100) / max(1, n))
        ceiling = F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * share)))
        rows = df.select(F.col(self.get("id_col")).alias("row_id"), *self.get("cols"))
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("row_id", t, seed) <= ceiling)
        order = Window.partitionBy("tree").orderBy("_draw", "row_id")
        return (
            rows.withColumn("tree", F.explode(drawn))
            .withColumn("_draw", F.xxhash64("row_id", "tree", seed))
            .withColumn("_place", F.row_number().over(order))
            .where(F.col("_place") <= sample)
            .select("tree", "row_id", *self.get("cols"))
        )

    def _fit(self, df: DataFrame) -> "IsolationForestModel":
        cols, seed = self.get("cols"), self.get("seed")
        n = df.count()
        samples = self.samples(df, n)
        grown = samples.groupBy("tree").applyInPandas(_grow(cols, seed), NODES).toPandas()
        forest = [
            group.sort_values("node").drop(columns=["tree", "node"]).to_dict("list")
            for _, group in grown.groupby("tree")
        ]
        size = min(self.get("sample"), n)
        model = IsolationForestModel(cols=cols, forest=forest, sample=size)
        scored = df.select(model.score().alias("score"))
        cut = fitted_quantiles(scored, ["score"], [1 - self.get("contamination")])["score"][0]
        return model.copy({model.getParam("threshold"): cut})


class IsolationForestModel(_ForestSettings, Model):
    forest = setting("forest", "node lists per tree")
    sample = setting("sample", "rows per tree")
    threshold = setting("threshold", "scores above it are outliers")

    def score(self) -> Column:
        """Anomaly score in (0, 1) of the feature columns."""
        trees = [{name: np.array(v) for name, v in tree.items()} for tree in self.get("forest")]
        usual = unsuccessful_search(self.get("sample")) or 1.0

        @F.pandas_udf("double")
        def isolate(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            every = np.arange(len(values))
            paths = np.zeros(len(values))
            for tree in trees:
                at = np.zeros(len(values), dtype=int)
                while (inner := tree["feature"][at] >= 0).any():
                    feature = np.maximum(tree["feature"][at], 0)
                    left = values[every, feature] <= tree["threshold"][at]
                    step = np.where(left, tree["left"][at], tree["right"][at])
                    at = np.where(inner, step, at)
                paths += tree["path"][at]
            return pd.Series(2.0 ** (-paths / len(trees) / usual))

        return isolate(*[F.col(c).cast("double") for c in self.get("cols")])

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("anomaly_score", self.score())
        return scored.withColumn("is_outlier", F.col("anomaly_score") > self.get("threshold"))


def keep_inliers(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("is_outlier"))


class CleanThenFit(Estimator):
    """Preprocess, drop the outliers, then fit the model on the raw rows that are left."""

    def __init__(self, pre: Estimator, detector: Estimator, est: Estimator):
        super().__init__()
        self.pre, self.detector, self.est = pre, detector, est

    def clean(self, df: DataFrame) -> DataFrame:
        """The raw rows the detector keeps."""
        prepared = self.pre.fit(df).transform(packed(df))
        scored = self.detector.fit(prepared).transform(prepared)
        return keep_inliers(scored).select(f"{RAW}.*")

    def _fit(self, df: DataFrame) -> Model:
        return self.est.fit(self.clean(df))
