"""Cross-validation, voting, bagging, stacking and pseudo-labels.

Every base learner of an ensemble reads the same prepared rows: preparation is
fitted once per fold, its result cached, and all learners score in one pass, so
their predictions never have to be joined back together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from math import exp, lgamma, log, sqrt
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.columns import augment
from tabforge.operators.order import hash32, kfold, stratified_kfold
from tabforge.plans.base import RAW, PartsModel, packed
from tabforge.plans.linear import Logistic, RidgeLoo
from tabforge.session import settle

PARALLEL_FITS = 4
#: Scores of a bake-off at a time; they read the same written rows and cache none of their own.
PARALLEL_SCORES = 8
#: Folds whose prepared rows are cached and fitted at a time.
PARALLEL_FOLDS = 3


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def column_stages(stages: Mapping[str, list[Estimator]] | list[Estimator], assembler) -> Pipeline:
    """Per-type stages in order, then one assembler."""
    ordered = stages if isinstance(stages, list) else [s for group in stages.values() for s in group]
    return Pipeline(stages=[*ordered, assembler])


def prefix(pipeline: Pipeline, drop_last: int = 1) -> Pipeline:
    """The pipeline without its last stages, to preprocess only."""
    return Pipeline(stages=pipeline.getStages()[:-drop_last])


def fit_all(bases: Mapping[str, Estimator], df: DataFrame) -> dict[str, Model]:
    """Fit independent learners on the same rows, a few at a time."""

    return _side_by_side(lambda name: bases[name].fit(df), list(bases), df)


def _side_by_side(fit: Callable, names: Sequence, df: DataFrame, most: int = PARALLEL_FITS) -> dict:
    pool = ThreadPool(min(most, len(names)))
    try:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), names)
        return dict(zip(names, models))
    finally:
        pool.close()


def add_score(model: Model, df: DataFrame, out: str, classify: bool) -> DataFrame:
    """Add the class probabilities (an array) or the prediction of one model, nothing else."""
    scored = model.transform(packed(df))
    value = vector_to_array("probability") if classify else F.col("prediction")
    return scored.select(f"{RAW}.*", value.alias(out))


def add_scores(models: Mapping[str, Model], df: DataFrame, classify: bool) -> DataFrame:
    for name, model in models.items():
        df = add_score(model, df, f"score_{name}", classify)
    return df


def out_of_fold(
    bases: Mapping[str, Estimator], df: DataFrame, folds: int, classify: bool,
    prepare: Estimator | None = None, fold_col: str = "fold",
) -> DataFrame:
    """Score every row with learners (and preparation) that never saw its fold."""
    df = settle(df)  # read twice per fold

    def score(fold: int) -> DataFrame:
        train, held = df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
        if prepare is not None:
            ready = prepare.fit(train)
            train, held = ready.transform(train), ready.transform(held)
        with cached(train) as rows:
            models = fit_all(bases, rows)
        return add_scores(models, held, classify)

    return reduce(DataFrame.unionByName, _side_by_side(score, range(folds), df, PARALLEL_FOLDS).values())


def cross_val(
    est: Estimator, df: DataFrame, metric: Callable[[], Column], folds: int, fold_col: str = "fold"
) -> DataFrame:
    """(fold, score) of rows with a label: a fit per fold on the other folds, a few at a time."""
    return bake_off({"": est}, df, metric, folds, fold_col).drop("model")


def bake_off(
    ests: Mapping[str, Estimator], df: DataFrame, metric: Callable[[], Column], folds: int, fold_col: str = "fold"
) -> DataFrame:
    """(model, fold, score) of several learners on the same folds."""
    df = settle(df)

    def score(name: str, fold: int) -> float:
        model = ests[name].fit(df.where(F.col(fold_col) != fold))
        scored = model.transform(df.where(F.col(fold_col) == fold))
        return scored.select("label", "prediction").agg(metric()).first()[0]

    tasks = {f"{fold} {name}": (name, fold) for name in ests for fold in range(folds)}
    scores = _side_by_side(lambda task: score(*tasks[task]), list(tasks), df, PARALLEL_SCORES)
    rows = [(*tasks[task], value) for task, value in scores.items()]
    return df.sparkSession.createDataFrame(rows, f"model string, {fold_col} int, score double")


def soft_vote(scores: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of arrays of class probabilities."""
    weights = weights or [1.0] * len(scores)
    total = float(sum(weights))

    def times(score: Column, share: float) -> Column:
        return F.transform(score, lambda p: p * share)

    weighted = [times(score, weight / total) for score, weight in zip(scores, weights)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), weighted)


def top_class(shares: Column) -> Column:
    """Most probable class; the lower one wins a tie."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")


def _decide(df: DataFrame, shares: Column) -> DataFrame:
    return (
        df.withColumn("_shares", shares)
        .withColumn("probability", array_to_vector("_shares"))
        .withColumn("prediction", top_class(F.col("_shares")))
        .drop("_shares")
    )


class SoftVote(Estimator):
    """Average the probabilities of several classifiers."""

    def __init__(self, bases: Mapping[str, Estimator], weights: list[float] | None = None):
        super().__init__()
        self.bases, self.weights = bases, weights

    def _fit(self, df: DataFrame) -> "SoftVoteModel":
        with cached(df) as rows:
            return SoftVoteModel(fit_all(self.bases, rows), self.weights)


class SoftVoteModel(PartsModel):
    def __init__(self, models: Mapping[str, Model], weights: list[float] | None = None):
        super().__init__()
        self.models, self.weights = models, weights

    def parts(self) -> tuple[dict[str, Model], dict]:
        return dict(self.models), {"weights": self.weights}

    @classmethod
    def of_parts(cls, parts: dict[str, Model], facts: dict) -> "SoftVoteModel":
        return cls(parts, facts["weights"])

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"score_{name}" for name in self.models]
        scored = add_scores(self.models, df, classify=True)
        return _decide(scored, soft_vote([F.col(n) for n in names], self.weights)).drop(*names)


def poisson_copies(row_id: Column, rate: float, seed: int) -> Column:
    """How often a row is drawn with replacement; depends on the key and the seed only.

    The bounds go on until what is left is less than the chance can tell apart, so
    any rate has its whole distribution.
    """
    chance = hash32(row_id, seed) / F.lit(2.0**32)
    bounds, reached, times = [], 0.0, 0
    while reached < 1 - 2.0**-33 and times < 2 * rate + 100 + 12 * sqrt(rate):
        reached += exp(times * log(rate) - rate - lgamma(times + 1)) if rate > 0 else 1.0
        bounds.append(F.lit(reached))
        times += 1
    return F.size(F.filter(F.array(*bounds), lambda bound: chance >= bound))


class Bagging(Estimator):
    """Fit a classifier on several samples with replacement and average it."""

    def __init__(self, est: Estimator, n: int, fraction: float, key: str, seed: int = 55):
        super().__init__()
        self.est, self.n, self.fraction, self.key, self.seed = est, n, fraction, key, seed

    def sample(self, df: DataFrame, number: int) -> DataFrame:
        copies = poisson_copies(F.col(self.key), self.fraction, self.seed + number)
        return df.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop(
            "_copy"
        )

    def _fit(self, df: DataFrame) -> SoftVoteModel:
        with cached(df) as rows:
            samples = {f"bag{number}": self.sample(rows, number) for number in range(self.n)}
            return SoftVoteModel(_side_by_side(lambda name: self.est.fit(samples[name]), list(samples), df))


class _Stack(Estimator):
    classify: bool

    def __init__(
        self, bases: Mapping[str, Estimator], key: str, folds: int = 5, seed: int = 42,
        prepare: Estimator | None = None, meta: Estimator | None = None,
    ):
        super().__init__()
        self.bases, self.key, self.folds, self.seed = bases, key, folds, seed
        self.prepare, self.meta = prepare, meta

    def folded(self, df: DataFrame) -> DataFrame:
        """Classes are dealt evenly, so that none misses a fold it could be in."""
        if self.classify:
            return stratified_kfold(df, self.key, "label", self.folds, self.seed, "_fold")
        return kfold(df, self.key, self.folds, self.seed, "_fold")

    def _fit_bases(self, df: DataFrame) -> tuple[DataFrame, Model | None, dict[str, Model]]:
        """Scores of unseen rows for the meta learner, and the learners fitted on all rows."""
        scored = out_of_fold(
            self.bases, self.folded(df), self.folds, self.classify, self.prepare, "_fold"
        )
        ready = None if self.prepare is None else self.prepare.fit(df)
        with cached(df if ready is None else ready.transform(df)) as rows:
            return scored, ready, fit_all(self.bases, rows)


def _meta_vector(names: list[str]) -> Column:
    """Class probabilities of all learners side by side; the first class is implied."""
    return array_to_vector(
        F.concat(*[F.slice(n, F.lit(2), F.size(n) - 1) for n in names])
    )


class StackClassifier(_Stack):
    """A logistic regression over the out-of-fold probabilities of the base learners."""

    classify = True

    def _fit(self, df: DataFrame) -> "StackModel":
        scored, ready, models = self._fit_bases(df)
        names = [f"score_{name}" for name in self.bases]
        meta = self.meta or Logistic(c=1.0, features="_meta")
        with cached(scored.select("label", _meta_vector(names).alias("_meta"))) as rows:
            return StackModel(ready, models, meta.fit(rows), classify=True)


class StackRegressor(_Stack):
    """A leave-one-out ridge over the out-of-fold predictions of the base learners."""

    classify = False

    def _fit(self, df: DataFrame) -> "StackModel":
        scored, ready, models = self._fit_bases(df)
        names = [f"score_{name}" for name in self.bases]
        meta = self.meta or RidgeLoo(cols=names)
        with cached(scored.select("label", *names)) as rows:
            return StackModel(ready, models, meta.fit(rows), classify=False)


class StackModel(PartsModel):
    def __init__(self, ready: Model | None, models: Mapping[str, Model], meta: Model, classify: bool):
        super().__init__()
        self.ready, self.models, self.meta, self.classify = ready, models, meta, classify

    def parts(self) -> tuple[dict[str, Model], dict]:
        prepared = {} if self.ready is None else {"ready": self.ready}
        bases = {f"base {name}": model for name, model in self.models.items()}
        return prepared | {"meta": self.meta} | bases, {"classify": self.classify}

    @classmethod
    def of_parts(cls, parts: dict[str, Model], facts: dict) -> "StackModel":
        bases = {name[5:]: model for name, model in parts.items() if name.startswith("base ")}
        return cls(parts.get("ready"), bases, parts["meta"], facts["classify"])

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"score_{name}" for name in self.models]
        rows = packed(df)
        rows = rows if self.ready is None else self.ready.transform(rows)
        scored = add_scores(self.models, rows, self.classify)
        if self.classify:
            scored = scored.withColumn("_meta", _meta_vector(names))
        wanted = ["probability", "prediction"] if self.classify else ["prediction"]
        return self.meta.transform(scored).select(f"{RAW}.*", *wanted)


def confident_rows(scored: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Rows whose most probable class is over the threshold."""
    return scored.where(F.array_max(vector_to_array("probability")) > threshold)


class PseudoLabel(Estimator):
    """Fit, label the unlabelled rows it is sure of, and fit again with them.

    Rows without a label are the unlabelled ones. Too few sure rows: keep the first fit.
    """

    def __init__(self, est: Estimator, threshold: float = 0.95, min_rows: int = 50):
        super().__init__()
        self.est, self.threshold, self.min_rows = est, threshold, min_rows

    def confident(self, first: Model, df: DataFrame) -> DataFrame:
        unknown = packed(df.where(F.col("label").isNull()).drop("label"))
        sure = confident_rows(first.transform(unknown), self.threshold)
        return sure.select(f"{RAW}.*", F.col("prediction").alias("label")).select(*df.columns)

    def _fit(self, df: DataFrame) -> Model:
        df = df.withColumn("label", F.col("label").cast("double"))
        known = df.where(F.col("label").isNotNull())
        first = self.est.fit(known)
        with cached(self.confident(first, df)) as sure:
            if sure.count() <= self.min_rows:
                return first
            return self.est.fit(augment(known, sure))


class LogTargetModel(PartsModel):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def parts(self) -> tuple[dict[str, Model], dict]:
        return {"model": self.model}, {}

    @classmethod
    def of_parts(cls, parts: dict[str, Model], facts: dict) -> "LogTargetModel":
        return cls(parts["model"])

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn("prediction", F.expm1("prediction"))


class LogTarget(Estimator):
    """Fit a regressor on log1p of the label; predictions come back on the label's scale."""

    def __init__(self, est: Estimator):
        super().__init__()
        self.est = est

    def _fit(self, df: DataFrame) -> LogTargetModel:
        return LogTargetModel(self.est.fit(df.withColumn("label", F.log1p("label"))))


def predict(model: Model, df: DataFrame, id_col: str, out: str, label_type: str) -> DataFrame:
    """(id, prediction) with the prediction typed as the label was."""
    scored = model.transform(df)
    return scored.select(id_col, F.col("prediction").cast(label_type).alias(out))
