"""Ready-made learners. All read ``features`` and ``label``."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.neighbors import knn_join
from tabforge.plans.base import Configured, TableModel, setting
from tabforge.plans.extratrees import ExtraTrees
from tabforge.plans.histboost import HistBoost
from tabforge.plans.kernels import FourierClassifier, FourierRegressor
from tabforge.plans.targets import OrderedTargets

CHECKPOINT_EVERY = 10


def forest_classifier(trees=100, depth=10, min_rows=1, seed=42) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed
    )


def forest_regressor(trees=100, depth=10, min_rows=1, seed=42) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed
    )


def boost_classifier(rounds=200, step=0.05, depth=4, subsample=1.0, seed=42) -> GBTClassifier:
    return GBTClassifier(
        maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=subsample, seed=seed,
        checkpointInterval=CHECKPOINT_EVERY,
    )


def hist_boost_classifier(rounds=100, step=0.1, leaves=31, l2=0.0, bins=255, min_rows=20, seed=42) -> HistBoost:
    return HistBoost(
        loss="logistic", rounds=rounds, step=step, leaves=leaves, l2=l2, bins=bins, min_rows=min_rows, seed=seed
    )


def hist_boost_regressor(rounds=100, step=0.1, leaves=31, l2=0.0, bins=255, min_rows=20, seed=42) -> HistBoost:
    return HistBoost(rounds=rounds, step=step, leaves=leaves, l2=l2, bins=bins, min_rows=min_rows, seed=seed)


def extra_trees(trees=300, depth=20, min_rows=1, seed=42) -> ExtraTrees:
    return ExtraTrees(trees=trees, depth=depth, min_rows=min_rows, seed=seed)


def tree_classifier(depth=10, seed=42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed)


def extra_tree(depth=20, seed=42) -> ExtraTrees:
    """One tree of ``extra_trees``."""
    return extra_trees(trees=1, depth=depth, seed=seed)


def gaussian_nb() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def boost_preset(name: str, rounds: int | None = None, step=None, depth=None, share=None, key=None, seed: int = 42):
    """Boosting as three well-known libraries do it by default.

    'sampled': depth-limited trees, penalised gains and leaf values, a sample of rows and
    features (``share``) per round. 'leafwise': the best leaf is split until there are 31,
    on a share of the features if one is given. 'target_encoded': ordered target
    statistics of the categories and symmetric trees.
    """
    if name == "sampled":
        depth = depth or 4
        return HistBoost(
            rounds=rounds or 2000, step=step or 0.01, depth=depth, leaves=2**depth, l2=1.0, min_weight=1.0, min_rows=1,
            bins=256, rows_share=share or 0.7, columns_share=share or 0.7, key=key, seed=seed,
        )
    if name == "leafwise":
        return HistBoost(
            rounds=rounds or 1000, step=step or 0.01, depth=depth, leaves=31, min_weight=0.001, min_rows=20,
            columns_share=share or 1.0, key=key, seed=seed,
        )
    if name == "target_encoded":
        return TargetEncodedBoost(
            rounds=rounds or 1500, step=step or 0.05, depth=depth or 6, key=key, seed=seed
        )
    raise ValueError(f"no such preset: {name}")


class TargetEncodedBoost(Configured, Estimator):
    """Symmetric trees on ordered target statistics of the categories and on ``features``."""

    cols = setting("cols", "indexed category columns; none given: all '<name>_index' columns")
    rounds = setting("rounds", "number of trees")
    step = setting("step", "learning rate")
    depth = setting("depth", "levels of each tree")
    l2 = setting("l2", "penalty on leaf values")
    key = setting("key", "row key that decides the order; none: the row itself")
    seed = setting("seed", "seed of the order")
    defaults = {"cols": None, "rounds": 1500, "step": 0.05, "depth": 6, "l2": 3.0, "key": None, "seed": 42}

    def _fit(self, df: DataFrame) -> PipelineModel:
        cols = self.get("cols") or [c for c in df.columns if c.endswith("_index")]
        rows, key = df, self.get("key")
        if key is None:
            key = "_key"
            rows = df.withColumn(key, F.xxhash64(vector_to_array("features"), F.col("label").cast("double"), *cols))
        targets = OrderedTargets(cols=cols, key=key, seed=self.get("seed"))
        assemble = VectorAssembler(inputCols=[*targets.encoded(), "features"], outputCol="_boosted")
        boost = HistBoost(
            shape="symmetric", rounds=self.get("rounds"), step=self.get("step"), depth=self.get("depth"), l2=self.get("l2"),
            min_rows=1, seed=self.get("seed"), features="_boosted",
        )
        fitted = boost.fit(assemble.transform(_numbers(targets.training(rows), targets.encoded())))
        return PipelineModel(stages=[targets.fit(df), _AsNumbers(cols=targets.encoded()), assemble, fitted])


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) + 0.0 for c in cols})


class _AsNumbers(Configured, Transformer):
    """Forget that encoded columns once were categories."""

    cols = setting("cols", "columns to free of their category marks")

    def _transform(self, df: DataFrame) -> DataFrame:
        return _numbers(df, self.get("cols"))


def rff_classifier(gamma=0.1, c=10.0, dims=256, seed=42) -> FourierClassifier:
    """RBF machine with hinge loss and held-out sigmoid, on random Fourier features."""
    return FourierClassifier(gamma=gamma, c=c, dims=dims, seed=seed)


def rff_regressor(gamma=0.0003, c=20.0, epsilon=0.008, dims=256, seed=42) -> FourierRegressor:
    """RBF support vector regression, on random Fourier features."""
    return FourierRegressor(gamma=gamma, c=c, epsilon=epsilon, dims=dims, seed=seed)


class _NeighbourSettings(Configured):
    k = setting("k", "number of neighbours")
    weights = setting("weights", "'uniform' or 'distance'")
    id_col = setting("id_col", "row key")
    features = setting("features", "vector column")
    label = setting("label", "label column")
    classes = setting("classes", "number of classes")
    defaults = {
        "k": 10, "weights": "uniform", "features": "features", "label": "label", "classes": 2,
    }


class KnnClassifier(_NeighbourSettings, Estimator):
    """Vote of the k nearest fitted rows, exact. The fitted rows stay a DataFrame."""

    def _fit(self, df: DataFrame) -> "KnnModel":
        donors = df.select(
            F.col(self.get("id_col")).alias("did"),
            F.lit("").alias("space"),
            vector_to_array(self.get("features")).alias("vec"),
            F.col(self.get("label")).cast("double").alias("payload"),
        )
        return KnnModel(
            tables={"donors": donors}, **{name: self.get(name) for name in (
                "k", "weights", "id_col", "features", "label", "classes")}
        )


class KnnModel(_NeighbourSettings, TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        key = self.get("id_col")
        receivers = df.select(
            F.col(key).alias("rid"), F.lit("").alias("target"), F.lit("").alias("space"),
            F.lit(1.0).alias("scale"), vector_to_array(self.get("features")).alias("vec"),
        )
        found = knn_join(receivers, self.tables["donors"], self.get("k"))
        distance = F.sqrt("distance2")
        if self.get("weights") == "distance":
            # A donor at distance 0 outweighs all others; several share the vote.
            weigh = F.struct(
                F.sum(F.when(F.col("distance2") > 0, 0).otherwise(1)).alias("equal"),
                F.sum(F.try_divide(F.lit(1.0), distance)).alias("near"),
            )
        else:
            weigh = F.struct(
                F.lit(0).alias("equal"), F.count("*").cast("double").alias("near")
            )
        votes = found.groupBy("rid", "payload").agg(weigh.alias("w"))
        equal = F.max("w.equal") > 0
        shares = votes.groupBy(F.col("rid").alias(key)).agg(
            *[
                F.when(equal, F.sum(F.when(F.col("payload") == c, F.col("w.equal"))))
                .otherwise(F.sum(F.when(F.col("payload") == c, F.col("w.near"))))
                .alias(f"_vote_{c}")
                for c in range(self.get("classes"))
            ]
        )
        counts = [F.coalesce(F.col(f"_vote_{c}").cast("double"), F.lit(0.0))
                  for c in range(self.get("classes"))]
        total = sum(counts[1:], counts[0])
        out = df.join(shares, key, "left").withColumn(
            "_shares", F.array(*[F.try_divide(count, total) for count in counts])
        )
        place = F.array_position("_shares", F.array_max("_shares")) - 1
        return (
            out.withColumn("probability", array_to_vector("_shares"))
            .withColumn("prediction", place.cast("double"))
            .drop("_shares", *[f"_vote_{c}" for c in range(self.get("classes"))])
        )
