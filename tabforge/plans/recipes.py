"""Complete trainings for the three data sets, from raw rows to predictions.

Every recipe is an Estimator over the raw columns plus ``label``. The numbers are
those of the published solutions; ``effort`` scales the numbers of trees and
rounds down for a quick run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.mapping import PORT_CODES
from tabforge.functions.numeric import AGE_EDGES, FARE_EDGES
from tabforge.functions.text import concat_cols
from tabforge.operators.columns import (
    exclude_ids,
    filter_below,
    numeric_columns,
    present_or_first,
    string_columns,
)
from tabforge.plans import blocks, boosting, encode, ensemble, impute, linear, manifold, models
from tabforge.plans import outlier, scale
from tabforge.plans.base import Configured, Settled, setting

# Outlier rules and column choices of the published solutions.
LIVING_AREA_BOUND = 4500
OUTLIER_HOUSES = [1299, 524]
CLUSTER_AREAS = ["LotArea", "GrLivArea", "TotalBsmtSF", "1stFlrSF", "GarageArea"]
BASIC_A = ["Pclass", "sex_code", "Age", "SibSp", "Parch", "Fare", "Embarked"]
CATEGORIES_B = ["HomePlanet", "CryoSleep", "Destination", "VIP"]


class MixedPrep(Configured, Estimator):
    """Impute, scale and encode columns by their kind, then assemble ``features``.

    Columns not named are found by type when fitting, except the excluded ones.
    """

    numeric = setting("numeric", "numeric columns; not given: all of them")
    categories = setting("categories", "category columns; not given: all strings")
    exclude = setting("exclude", "columns that are no features")
    key = setting("key", "row key, for the nearest-neighbour imputer")
    neighbours = setting("neighbours", "neighbours of the imputer; not given: the median")
    scaler = setting("scaler", "'iqr', 'std', 'quantile' or 'none'")
    encoder = setting("encoder", "'one_hot' or 'ordinal'")
    defaults = {
        "numeric": None, "categories": None, "exclude": [], "key": None, "neighbours": None,
        "scaler": "iqr", "encoder": "one_hot",
    }

    def _fit(self, df: DataFrame):
        exclude = {*self.get("exclude"), self.get("key"), "label"}
        numeric = self.get("numeric") or [c for c in numeric_columns(df) if c not in exclude]
        words = self.get("categories")
        if words is None:
            words = [c for c in string_columns(df) if c not in exclude]
        if self.get("neighbours"):
            stages = [impute.KnnImputer(cols=numeric, id_col=self.get("key"),
                                        k=self.get("neighbours"))]
        else:
            stages = [impute.MedianImputer(cols=numeric)]
        scalers = {"iqr": scale.IqrScaler, "std": scale.StdScaler, "quantile": scale.QuantileNormal}
        if self.get("scaler") in scalers:
            stages.append(scalers[self.get("scaler")](cols=numeric))
        stages.append(Settled())
        encoded = []
        if words:
            stages.append(impute.ModeImputer(cols=words))
            if self.get("encoder") == "one_hot":
                stages.append(encode.one_hot(words))
                encoded = [f"{c}_hot" for c in words]
            else:
                stages.append(encode.OrdinalCodes(cols=words))
                encoded = [f"{c}_code" for c in words]
        stages.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol="features"))
        return Pipeline(stages=stages).fit(df)


class _DeckSide(Configured, Transformer):
    """Deck and side as one category."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("deck_side", concat_cols(F.col("deck"), F.col("side")))


def _count(number: int, effort: float) -> int:
    return max(2, round(number * effort))


# --- first manifest ---------------------------------------------------------------------


def manifest_a(
    version: str, key: str = "PassengerId", effort: float = 1.0, folds: int = 5
) -> Estimator:
    """'baseline', 'voting', 'stacking' or 'notebook'."""

    def many(number: int) -> int:
        return _count(number, effort)

    ports = blocks.MapCodes(codes={"Embarked": PORT_CODES})
    if version == "baseline":
        return Pipeline(stages=[
            impute.MedianImputer(cols=["Age", "Fare"]), impute.ModeImputer(cols=["Embarked"]),
            blocks.PassengerBlock(), ports,
            VectorAssembler(inputCols=BASIC_A, outputCol="features"),
            models.forest_classifier(trees=many(100)),
        ])
    if version == "voting":
        features = ["Pclass", "sex_code", "Age", "SibSp", "Parch", "Fare", "Embarked",
                    "title_code", "family_size", "is_alone"]
        return Pipeline(stages=[
            impute.ModeImputer(cols=["Embarked"]), impute.MedianImputer(cols=["Fare"]),
            impute.GroupMedianImputer(keys=["Pclass", "Sex"], col="Age", default=28.0),
            blocks.PassengerBlock(), ports, blocks.LogColumns(cols=["Fare"], how="log_pos"),
            VectorAssembler(inputCols=features, outputCol="features"),
            ensemble.SoftVote({
                "forest": models.forest_classifier(trees=many(500), depth=6),
                "boost": models.boost_classifier(rounds=many(500), step=0.05, depth=3),
            }),
        ])
    if version == "stacking":
        numbers = ["Pclass", "sex_code", "Age", "SibSp", "Parch", "Fare", "family_size", "is_alone"]
        prepare = Pipeline(stages=[
            blocks.PassengerBlock(), impute.ModeImputer(cols=["Embarked"]),
            impute.GroupMedianImputer(keys=["Pclass"], col="Fare"),
            blocks.LogColumns(cols=["Fare"]),
            MixedPrep(numeric=numbers, categories=["title", "Embarked", "deck"], key=key,
                      neighbours=5),
        ])
        return ensemble.StackClassifier({
            "forest": models.forest_classifier(trees=many(200), depth=10),
            "boost": models.boost_classifier(rounds=many(200), step=0.05, depth=4),
            "fourier": models.rff_classifier(gamma=0.1, c=10.0),
            "knn": models.KnnClassifier(k=10, id_col=key),
            "ada": boosting.AdaBoost(rounds=many(100)),
        }, key=key, folds=folds, prepare=prepare)
    if version == "notebook":
        features = ["Pclass", "sex_code", "Age", "Fare", "Embarked", "title_group", "deck_scale",
                    "family_scale"]
        return Pipeline(stages=[
            blocks.PassengerBlock(), impute.FillModel(fills={"Embarked": "S"}), ports,
            impute.GroupMedianImputer(keys=["title_group"], col="Age"),
            impute.GroupMedianImputer(keys=["Pclass"], col="Fare"),
            impute.GroupMedianImputer(keys=["Pclass"], col="deck_scale", default=0.0),
            blocks.RightBins(edges={"Age": list(AGE_EDGES), "Fare": list(FARE_EDGES)}),
            VectorAssembler(inputCols=features, outputCol="features"),
            ensemble.SoftVote({
                "fourier": models.rff_classifier(gamma=0.125, c=1.0),
                "knn": models.KnnClassifier(k=13, id_col=key),
                "boost": models.boost_classifier(rounds=many(500), step=0.05, depth=3),
            }),
        ])
    raise ValueError(f"no such version: {version}")


# --- second manifest --------------------------------------------------------------------


def _features_b(version: int, key: str, effort: float) -> Pipeline:
    logs = [f"log_{c}" for c in blocks.SPEND]
    categories = [*CATEGORIES_B, "deck", "side"]
    if version == 1:
        return Pipeline(stages=[
            MixedPrep(numeric=["Age", *blocks.SPEND], categories=CATEGORIES_B, scaler="none",
                      encoder="ordinal"),
        ])
    stages = [blocks.SleepRule(), blocks.SpendBlock(), blocks.SocialBlock(id_col=key)]
    numbers = ["Age", *logs, "log_total_spend", "group_size"]
    neighbours, scaler = 5, "std"
    if version == 3:
        stages.append(_DeckSide())
        categories, numbers, scaler = [*categories, "deck_side"], [*numbers, "zero_spend"], "iqr"
    if version in (5, 6):
        stages = [blocks.AwakeFromSpend(),
                  impute.GroupModeFill(id_col=key, col="HomePlanet"), *stages]
    if version in (4, 6):
        numbers += ["luxury_ratio", "sustenance_ratio", "log_spend_power", "relative_position",
                    "group_rank_norm"]
        neighbours, scaler = 9, "quantile"
    if version == 5:
        stages.append(blocks.PassengerDeck())
        numbers += ["log_luxury_spend", "log_sustenance_spend", "deck_order", "relative_position"]
        neighbours, scaler = 15, "iqr"
    if version in (7, 8):
        numbers += ["luxury_ratio", "sustenance_ratio", "relative_position", "family_size",
                    "occupancy", "zero_spend", "is_child", "is_senior"]
        neighbours, scaler = 15, "quantile"
    if version >= 9:
        matrix = [f"m_{c}" for c in [*blocks.SPEND, "total", "Age"]]
        if version >= 10:
            stages = [impute.FillModel(fills={c: 0.0 for c in blocks.SPEND}),
                      scale.Winsorizer(cols=blocks.SPEND), *stages]
        stages += [blocks.ClusterMatrix(), manifold.ClusterId(cols=matrix, k=12, restarts=_count(10, effort)),
                   manifold.PcaFeatures(cols=matrix, k=2)]
        categories += ["cabin_region", "cluster_id"]
        numbers += ["relative_position", "family_size", "occupancy", "zero_spend", "pca_1", "pca_2"]
        neighbours, scaler = 15, "quantile"
    stages.append(MixedPrep(numeric=numbers, categories=categories, key=key,
                            neighbours=neighbours, scaler=scaler, encoder="ordinal"))
    return Pipeline(stages=stages)


def _learners_b(version: int, key: str, effort: float) -> tuple[dict, list[float] | None]:
    """Base learners of a version and their voting weights."""

    def many(number: int) -> int:
        return _count(number, effort)

    def hist(rounds, step=0.1, leaves=31, l2=0.0):
        return models.hist_boost_classifier(rounds=many(rounds), step=step, leaves=leaves, l2=l2)

    def bag(est, n, fraction):
        return ensemble.Bagging(est, _count(n, effort), fraction, key)

    if version == 1:
        return {"forest": models.forest_classifier(trees=many(100))}, None
    if version == 2:
        return {"hist": hist(200), "forest": models.forest_classifier(trees=many(200))}, None
    if version == 3:
        return {
            "bag": bag(hist(300), 10, 0.7),
            "extra": models.extra_trees(trees=many(300), seed=2),
            "boost": models.boost_classifier(rounds=many(200), step=0.1, depth=3, subsample=0.8),
        }, [2.0, 1.0, 1.0]
    if version in (4, 6):
        return {
            "bag": bag(hist(350, 0.05, 40), 10, 0.7),
            "extra": models.extra_trees(trees=many(350), min_rows=3),
            "boost": models.boost_classifier(rounds=many(250), depth=3, subsample=0.75),
        }, [3.0, 1.0, 1.0]
    if version == 5:
        return {
            "slow": hist(500, 0.03, 60, 0.5), "fast": hist(100),
            "extra": models.extra_trees(trees=many(400), seed=44),
        }, [3.0, 1.0, 2.0]
    if version in (7, 8):
        return {
            "bag": bag(hist(500, 0.03, l2=3.0), 12, 0.7),
            "extra": models.extra_trees(trees=many(500), min_rows=4, seed=99),
            "boost": models.boost_classifier(rounds=many(300), step=0.1, depth=5, subsample=0.8),
        }, [3.0, 1.0, 1.0]
    learners = {
        "bag": bag(hist(500, 0.03, 50, 2.0), 10, 0.75),
        "extra": models.extra_trees(trees=many(450), min_rows=3, seed=99),
    }
    if version == 11:
        knn = models.KnnClassifier(k=15, weights="distance", id_col=key)
        return learners | {"knn": knn}, None
    boost = models.boost_classifier(rounds=many(300), step=0.1, depth=5, subsample=0.8)
    return learners | {"boost": boost}, [3.0, 1.0, 1.0]


def manifest_b(
    version: int, key: str = "PassengerId", effort: float = 1.0, folds: int = 5
) -> Estimator:
    """Versions 1 to 11. Version 8 also learns from the rows without a label."""
    if version not in range(1, 12):
        raise ValueError(f"no such version: {version}")
    learners, weights = _learners_b(version, key, effort)
    prepare = _features_b(version, key, effort)
    if version == 11:
        stack = ensemble.StackClassifier(learners, key=key, folds=folds, prepare=prepare)
        return _cleaned(prepare, stack, key)
    whole = Pipeline(stages=[prepare, ensemble.SoftVote(learners, weights)])
    if version == 8:
        return ensemble.PseudoLabel(whole, threshold=0.95, min_rows=50)
    return _cleaned(prepare, whole, key) if version == 10 else whole


class _Unpacked(Configured, Transformer):
    """The prepared vector as plain columns, which is what the detector splits on."""

    cols = setting("cols", "columns the detector uses")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                               for c in self.get("cols")})


def _cleaned(prepare: Estimator, est: Estimator, key: str) -> Estimator:
    seen = ["Age", *[f"log_{c}" for c in blocks.SPEND], "log_total_spend", "group_size",
            "relative_position", "family_size", "occupancy", "zero_spend", "pca_1", "pca_2",
            "HomePlanet_code", "CryoSleep_code", "Destination_code", "VIP_code", "deck_code",
            "side_code", "cabin_region_code", "cluster_id_code"]
    ready = Pipeline(stages=[prepare, _Unpacked(cols=seen)])
    return outlier.CleanThenFit(ready, outlier.IsolationForest(cols=seen, id_col=key), est)


# --- house sales ------------------------------------------------------------------------

# Base learners per version.
HOUSE_LEARNERS = {
    2: ["huber", "lasso", "ridge", "hist"],
    3: ["sampled", "leafwise", "poly", "lasso_cv"],
    4: ["huber", "lasso", "ridge", "hist", "sampled", "leafwise"],
    5: ["lasso", "ridge", "huber", "hist", "sampled", "leafwise"],
    6: ["huber", "lasso", "ridge", "hist", "sampled", "leafwise"],
    7: ["huber", "lasso", "ridge", "hist", "sampled", "leafwise"],
    8: ["huber", "hist", "sampled", "leafwise", "target_encoded", "lasso", "ridge", "poly"],
    9: ["huber", "hist", "sampled", "leafwise", "target_encoded", "lasso", "ridge", "elastic",
        "poly", "fourier"],
}


# Products of the quality by version, and their clamps.
HOUSE_PRODUCTS = {
    5: {"interactions": ["quality_area", "quality_living"]},
    6: {"interactions": ["quality_area", "quality_living", "quality_built"], "cap": 35000},
    7: {"interactions": ["quality_living"], "cap": 40000},
    8: {"interactions": ["quality_living"], "cap": 40000},
    9: {"interactions": ["quality_area", "quality_living", "quality_age"]},
}


def clean_houses(df: DataFrame, version: int, key: str = "Id") -> DataFrame:
    """Drop the training rows the version calls outliers."""
    if version == 1:
        return df
    kept = exclude_ids(df, key, OUTLIER_HOUSES) if version == 9 else df
    return filter_below(kept, "GrLivArea", LIVING_AREA_BOUND)


class HouseFeatures(Configured, Estimator):
    """Everything before imputation: which steps run depends on the version."""

    version = setting("version", "2 to 9")
    key = setting("key", "row key")
    restarts = setting("restarts", "runs of the clustering")
    order = setting("order", "'cap_log': caps come before logs; 'log_cap': after them")
    defaults = {"restarts": 10, "order": "cap_log"}

    def _fit(self, df: DataFrame):
        version = self.get("version")
        numeric = [c for c in numeric_columns(df) if c not in (self.get("key"), "label")]
        stages = [blocks.NoneCategories()]
        if version in (5, 6, 9):
            stages.append(blocks.QualityScale())
        caps = [scale.Winsorizer(cols=numeric)] if version in (4, 6, 7, 8, 9) else []
        logs = [blocks.Deskew(cols=numeric, bias=version == 5)] if version in (5, 9) else []
        stages += caps + logs if self.get("order") == "cap_log" else logs + caps
        areas = present_or_first(df.select(*numeric), CLUSTER_AREAS)
        logged, plain = [f"m_{c}" for c in areas], [f"f_{c}" for c in numeric]
        stages += [
            blocks.HouseBlock(**HOUSE_PRODUCTS.get(version, {"interactions": []})),
            blocks.FilledCopies(cols=areas),
            manifold.ClusterId(
                cols=logged, k={3: 8, 9: 12}.get(version, 10), restarts=self.get("restarts")
            ),
            blocks.FilledCopies(cols=numeric, prefix="f_", log=False),
            manifold.PcaFeatures(cols=plain, k=5 if version == 3 else 3),
            blocks.DropColumns(cols=[*logged, *plain]),
        ]
        return Pipeline(stages=stages).fit(df)


def house_learners(names: Sequence[str], version: int, effort: float = 1.0) -> dict[str, Estimator]:
    def many(number: int) -> int:
        return _count(number, effort)

    last = version == 9
    every = {
        "huber": lambda: boosting.HuberBoost(rounds=many(3000 if last else 1000)),
        "hist": lambda: models.hist_boost_regressor(
            rounds=many(1000 if last else 500), step=0.05 if last else 0.1),
        "sampled": lambda: models.boost_preset(
            "sampled", rounds=many(3000 if last else 2000), depth=5 if last else 4),
        "leafwise": lambda: models.boost_preset(
            "leafwise", rounds=many(2000 if last else 1000), share=0.8 if version in (3, 9) else None),
        "target_encoded": lambda: models.boost_preset(
            "target_encoded", rounds=many(3000 if last else 1500), step=0.01 if last else 0.05),
        "lasso": lambda: linear.Lasso(alpha=0.0005),
        "ridge": lambda: linear.Ridge(alpha=10.0),
        "elastic": lambda: linear.ElasticNet(alpha=0.0005, ratio=0.9),
        "lasso_cv": lambda: linear.lasso_cv([0.0001, 0.0005, 0.001, 0.005, 0.01]),
        "poly": lambda: linear.PolyRidge(alpha=0.6, coef0=2.5),
        "fourier": lambda: models.rff_regressor(gamma=0.0003, c=20.0),
    }
    return {name: every[name]() for name in names}


def houses(version: int, key: str = "Id", effort: float = 1.0, folds: int = 5) -> Estimator:
    """Versions 1 to 9 on rows already cleaned; predictions are prices."""
    if version == 1:
        return ensemble.LogTarget(Pipeline(stages=[
            blocks.NoneCategories(), MixedPrep(key=key, scaler="none", encoder="ordinal"),
            models.forest_regressor(trees=_count(100, effort)),
        ]))
    learners = house_learners(HOUSE_LEARNERS[version], version, effort)
    features = HouseFeatures(version=version, key=key, restarts=_count(10, effort))
    prepare = Pipeline(stages=[features, Settled(), MixedPrep(key=key)])
    return ensemble.LogTarget(
        ensemble.StackRegressor(learners, key=key, folds=folds, prepare=prepare)
    )
