import random
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabforge.functions.mapping import FAMILY_SCALE_SHORT
from tabforge.operators import stats
from tabforge.operators.order import kfold
from tabforge.plans import (
    answers, blocks, boosting, encode, ensemble, impute, linear, manifold, models, outlier, scale,
)


def values(df, *cols):
    return [tuple(r) for r in df.orderBy("id").select(*cols).collect()]


def frame(spark, rows, schema):
    names = ["id long", *schema.split(", ")]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], ", ".join(names))


@pytest.fixture(scope="module")
def passengers(spark):
    rows = [
        ("0001_01", "Ann Lee", "B/0/P", True, None, 10.0, 0.0, None, 5.0, 0.0),
        ("0002_01", "Bob Lee", "B/100/S", None, 30.0, 10.0, 0.0, 4.0, 5.0, 0.0),
        ("0002_02", None, None, None, 70.0, None, None, None, None, None),
        ("0003_01", "Eve Poe", "A/301/S", False, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    return spark.createDataFrame(
        rows,
        "PassengerId string, Name string, Cabin string, CryoSleep boolean, Age double, "
        "RoomService double, FoodCourt double, ShoppingMall double, Spa double, VRDeck double",
    )


def by_passenger(df, *cols):
    return {r["PassengerId"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_sleep_rules(passengers):
    awake = by_passenger(blocks.AwakeFromSpend().transform(passengers), "CryoSleep")
    assert awake == {"0001_01": (True,), "0002_01": (False,), "0002_02": (None,),
                     "0003_01": (False,)}
    slept = by_passenger(blocks.SleepRule().transform(passengers), "CryoSleep", "RoomService", "Spa")
    assert slept["0001_01"] == (True, 0.0, 0.0)
    assert slept["0002_02"] == (False, None, None)


def test_spend_block(passengers):
    out = by_passenger(
        blocks.SpendBlock().fit(passengers).transform(passengers),
        "total_spend", "luxury_spend", "sustenance_spend", "zero_spend", "is_child", "is_senior",
        "spend_power",
    )
    assert out["0001_01"] == (15.0, 15.0, None, 0, 0, 0, 0.5)  # median age 30
    assert out["0002_02"] == (0.0, None, None, 1, 0, 1, 0.0)
    assert out["0003_01"][3:6] == (1, 1, 0)


def test_social_block_saves_and_loads(passengers, tmp_path):
    model = blocks.SocialBlock().fit(passengers)
    cols = ("group_size", "family_size", "occupancy", "deck", "side", "cabin_region",
            "relative_position", "group_rank_norm", "is_solo")
    out = by_passenger(model.transform(passengers), *cols)
    assert out["0002_01"] == (2, 2, 1, "B", "S", 0, 1.0, 0.5, 0)
    assert out["0002_02"] == (2, 1, 1, "T", "P", 0, None, 1.0, 0)
    assert out["0003_01"] == (1, 1, 1, "A", "S", 1, 1.0, 1.0, 1)
    model.save(str(tmp_path / "social"))
    again = blocks.SocialBlockModel.load(str(tmp_path / "social"))
    assert by_passenger(again.transform(passengers), *cols) == out


def test_cluster_matrix_has_no_gaps(passengers):
    model = blocks.ClusterMatrix().fit(passengers)
    out = by_passenger(model.transform(passengers), *model.columns())
    assert all(v is not None for row in out.values() for v in row)
    assert out["0001_01"][:6] == (0.0,) * 6


def test_house_blocks(spark):
    houses = spark.createDataFrame(
        [(1, 5, None, 100.0, 50.0, 1500.0, 2000, 2005, 2, 1, 1, None, "Gd", None),
         (2, 9, 900.0, 900.0, 900.0, 4000.0, 1990, 1990, 2, 1, 0, 1, "odd", "Y")],
        "Id int, OverallQual int, TotalBsmtSF double, `1stFlrSF` double, `2ndFlrSF` double, "
        "GrLivArea double, YearBuilt int, YearRemodAdd int, FullBath int, HalfBath int, "
        "BsmtFullBath int, BsmtHalfBath int, ExterQual string, Fence string",
    )
    plain = blocks.HouseBlock().transform(houses).orderBy("Id").collect()
    assert plain[1]["quality_living"] == 36000
    assert "quality_area" not in blocks.HouseBlock(interactions=[]).transform(houses).columns
    out = blocks.HouseBlock(cap=35000).transform(houses).orderBy("Id").collect()
    assert (out[0]["total_area"], out[0]["total_bath"], out[0]["built_age"]) == (150.0, None, 10)
    assert out[1]["total_bath"] == 3.0 and out[1]["quality_living"] == 35000
    assert out[0]["quality_built"] == 10000 and out[0]["quality_age"] == 50
    graded = blocks.QualityScale().transform(blocks.NoneCategories().transform(houses))
    assert [(r["ExterQual"], r["Fence"]) for r in graded.orderBy("Id").collect()] == [
        (4, "None"), (0, "Y")]


def test_imputers(spark):
    df = frame(spark, [(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None)],
               "x double, c string")
    assert values(impute.MedianImputer(cols=["x"]).fit(df).transform(df), "x")[-1] == (3.0,)
    assert values(impute.ModeImputer(cols=["c"]).fit(df).transform(df), "c")[-1] == ("a",)


def _knn_by_hand(rows, k):
    data = np.array(rows, dtype=float)
    filled = data.copy()
    width = data.shape[1]
    for i, row in enumerate(data):
        for c in np.flatnonzero(np.isnan(row)):
            near = []
            for j, other in enumerate(data):
                both = ~np.isnan(row) & ~np.isnan(other)
                if not np.isnan(other[c]) and both.any():
                    gap = np.square(row[both] - other[both]).sum() * width / both.sum()
                    near.append((gap, j, other[c]))
            near.sort()
            filled[i, c] = np.mean([v for *_, v in near[:k]]) if near else np.nanmean(data[:, c])
    return filled


def test_knn_imputer_by_hand(spark):
    random.seed(2)
    rows = [tuple(None if random.random() < 0.2 else float(random.randint(0, 9))
                  for _ in range(4)) for _ in range(80)]
    rows.append((None, None, None, None))
    df = frame(spark, rows, "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    out = values(impute.KnnImputer(cols=cols, id_col="id", k=5).fit(df).transform(df), *cols)
    assert np.allclose(np.array(out, dtype=float), _knn_by_hand(rows, 5))


def test_encoders_and_unknown(spark):
    train = frame(spark, [("b",), ("a",), ("c",)], "c string")
    score = frame(spark, [("a",), ("d",), (None,)], "c string")
    assert values(encode.OrdinalCodes(cols=["c"]).fit(train).transform(score), "c_code") == [
        (0,), (-1,), (-1,)]
    assert values(encode.LabelCodes(cols=["c"]).fit(train).transform(score), "c_code") == [
        (0,), (None,), (None,)]
    hot = encode.one_hot(["c"]).fit(train).transform(score)
    assert values(hot.withColumn("v", vector_to_array("c_hot")), "v") == [
        ([1.0, 0.0, 0.0],), ([0.0, 0.0, 0.0],), ([0.0, 0.0, 0.0],)]
    dummies = encode.Dummies(cols=["c"]).fit(train)
    assert values(dummies.transform(score), *dummies.columns()) == [(0, 0)] * 3


def test_long_vocabulary_is_joined(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(encode, "LITERAL_CATEGORIES", 2)
    train = frame(spark, [("b",), ("a",), ("c",)], "c string")
    model = encode.OrdinalCodes(cols=["c"]).fit(train)
    assert list(model.tables) == ["c"]
    score = frame(spark, [("c",), ("d",)], "c string")
    assert values(model.transform(score), "c_code") == [(2,), (-1,)]
    model.save(str(tmp_path / "codes"))
    again = encode.OrdinalModel.load(str(tmp_path / "codes"))
    assert values(again.transform(score), "c_code") == [(2,), (-1,)]


def test_scalers(spark):
    df = frame(spark, [(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "x double, same double")
    out = values(scale.StdScaler(cols=["x", "same"]).fit(df).transform(df), "x", "same")
    assert [v for v, _ in out] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [v for _, v in out] == [0.0, 0.0, 0.0]
    out = values(scale.IqrScaler(cols=["x", "same"]).fit(df).transform(df), "x", "same")
    assert out == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    capped = scale.Winsorizer(cols=["x"], q=0.5).fit(df).transform(
        df.union(df.limit(1).selectExpr("9L", "CAST(NULL AS DOUBLE)", "5.0D")))
    assert values(capped, "x") == [(1.0,), (3.0,), (3.0,), (None,)]


def test_quantile_normal_is_monotonic(spark):
    random.seed(4)
    rows = [(random.expovariate(1),) for _ in range(500)] + [(0.0,)] * 250 + [(None,)]
    df = frame(spark, rows, "x double").withColumn("raw", F.col("x"))
    model = scale.QuantileNormal(cols=["x"], n_quantiles=100).fit(df)
    out = [r for r in model.transform(df).select("raw", "x").orderBy("raw").collect()]
    assert out[0]["x"] is None
    mapped = [r["x"] for r in out[1:]]
    assert mapped == sorted(mapped)
    assert mapped[0] == pytest.approx(-5.1993, abs=1e-3)
    assert mapped[-1] == pytest.approx(5.1993, abs=1e-3)


def test_model_round_trip_in_a_pipeline(spark, tmp_path):
    df = frame(spark, [(1.0, "a"), (None, "b"), (9.0, None)], "x double, c string")
    stages = Pipeline(stages=[
        impute.MedianImputer(cols=["x"]), impute.ModeImputer(cols=["c"]),
        scale.IqrScaler(cols=["x"]), encode.OrdinalCodes(cols=["c"]),
    ]).fit(df)
    stages.write().overwrite().save(str(tmp_path / "stages"))
    again = PipelineModel.load(str(tmp_path / "stages"))
    assert values(again.transform(df), "x", "c_code") == values(stages.transform(df), "x", "c_code")
    assert len(ensemble.prefix(Pipeline(stages=[1, 2, 3])).getStages()) == 2


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (1000, 2)).tolist() + (rng.normal(0, 1, (20, 2)) + 15).tolist()
    return frame(spark, [tuple(r) for r in rows], "x double, y double")


def test_isolation_forest_finds_planted_rows(cloud):
    detector = outlier.IsolationForest(cols=["x", "y"], id_col="id", contamination=0.02)
    out = detector.fit(cloud).transform(cloud)
    flagged = {r["id"] for r in out.where("is_outlier").select("id").collect()}
    assert len(flagged & set(range(1000, 1020))) >= 18
    assert abs(len(flagged) - 0.02 * 1020) <= 5
    again = detector.fit(cloud.repartition(5)).transform(cloud).where("is_outlier")
    assert {r["id"] for r in again.collect()} == flagged


def test_isolation_trees_draw_from_all_rows(cloud):
    detector = outlier.IsolationForest(cols=["x", "y"], id_col="id", trees=30, sample=40)
    drawn = detector.samples(cloud, 1020).toPandas()
    assert (drawn.groupby("tree").size() == 40).all() and drawn["tree"].nunique() == 30
    marks = cloud.select("id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("tree")).withColumn(
        "h", F.xxhash64("id", "tree", F.lit(42))).toPandas()
    least = marks.sort_values("h").groupby("tree").head(40)
    assert set(zip(least["tree"], least["id"])) == set(zip(drawn["tree"], drawn["row_id"]))
    assert drawn["row_id"].nunique() > 600


def test_pca_is_centred_and_orthonormal(cloud):
    model = manifold.PcaFeatures(cols=["x", "y"], k=2).fit(cloud)
    loadings = np.array(model.get("components"))
    assert np.allclose(loadings @ loadings.T, np.eye(2))
    assert all(row[np.abs(row).argmax()] > 0 for row in loadings)
    means = model.transform(cloud).agg(F.avg("pca_1"), F.avg("pca_2")).first()
    assert np.allclose(means, 0, atol=1e-9)


def test_cluster_restarts_never_cost_more(cloud):
    one = manifold.ClusterId(cols=["x", "y"], k=4, restarts=1).fit(cloud)
    many = manifold.ClusterId(cols=["x", "y"], k=4, restarts=4).fit(cloud)
    assert many.get("cost") <= one.get("cost") + 1e-9
    out = many.transform(cloud)
    assert {r[0] for r in out.select("cluster_id").distinct().collect()} == {0, 1, 2, 3}
    means = out.groupBy("cluster_id").agg(F.avg("x"), F.avg("y")).orderBy("cluster_id").collect()
    assert np.allclose([r[1:] for r in means], many.get("centres"))
    again = manifold.ClusterId(cols=["x", "y"], k=4, restarts=4).fit(cloud.repartition(7))
    assert again.get("centres") == many.get("centres")


def test_clusters_of_few_rows(spark):
    rows = frame(spark, [(1.0, 2.0), (1.0, 2.0), (5.0, 5.0)], "x double, y double")
    model = manifold.ClusterId(cols=["x", "y"], k=4, restarts=2).fit(rows)
    assert sorted(model.get("centres")) == [[1.0, 2.0], [5.0, 5.0]] and model.get("cost") == 0.0
    empty = manifold.ClusterId(cols=["x", "y"], k=2).fit(rows.where("id < 0"))
    assert empty.transform(rows).where("cluster_id IS NULL").count() == 3


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 2, (40, 2))
    y = 3 + 1.5 * x[:, 0] - 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.3, 40)
    df = frame(spark, [(*row, t) for row, t in zip(x.tolist(), y.tolist())],
               "a double, b double, label double")
    return x, y, VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


@pytest.mark.parametrize("widest_normal", [4096, 1])
def test_ridge_closed_form(line, monkeypatch, widest_normal):
    monkeypatch.setattr(linear, "NORMAL_SOLVER_FEATURES", widest_normal)
    x, y, df = line
    centred = x - x.mean(axis=0)
    slope = np.linalg.solve(centred.T @ centred + 10 * np.eye(2), centred.T @ (y - y.mean()))
    assert np.allclose(linear.Ridge(alpha=10.0).fit(df).coefficients.toArray(), slope, atol=1e-6)


def test_ridge_leave_one_out(line):
    x, y, df = line
    model = linear.RidgeLoo(cols=["a", "b"]).fit(df)
    errors = []
    for alpha in (0.1, 1.0, 10.0):
        misses = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            mean_x, mean_y = x[keep].mean(axis=0), y[keep].mean()
            cx = x[keep] - mean_x
            w = np.linalg.solve(cx.T @ cx + alpha * np.eye(2), cx.T @ (y[keep] - mean_y))
            misses.append((y[i] - mean_y - (x[i] - mean_x) @ w) ** 2)
        errors.append(np.mean(misses))
    assert np.allclose(model.get("errors"), errors)
    assert model.get("alpha") == [0.1, 1.0, 10.0][int(np.argmin(errors))]


@pytest.mark.parametrize("widest_normal", [4096, 1])
def test_poly_ridge_equals_the_kernel_solution(line, monkeypatch, widest_normal):
    monkeypatch.setattr(linear, "NORMAL_SOLVER_FEATURES", widest_normal)
    x, y, df = line
    kernel = (x @ x.T / 2 + 2.5) ** 2
    expected = kernel @ np.linalg.solve(kernel + 0.6 * np.eye(len(y)), y)
    fitted = linear.PolyRidge().fit(df).transform(df).orderBy("id").select("prediction")
    assert np.allclose([r[0] for r in fitted.collect()], expected, atol=1e-4)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 2))
    label = ((x[:, 0] ** 2 + x[:, 1] ** 2) < 1.2).astype(float)
    df = frame(spark, [(*row, t) for row, t in zip(x.tolist(), label.tolist())],
               "a double, b double, label double")
    return kfold(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df),
                 "id", 3, 1)


@pytest.mark.parametrize("name, at_least", [
    ("knn", 0.9), ("near", 0.99), ("ada", 0.6), ("fourier", 0.9), ("extra", 0.9), ("vote", 0.9),
    ("bag", 0.9),
])
def test_classifiers_learn_a_ring(labelled, name, at_least):
    est = {
        "knn": models.KnnClassifier(k=5, id_col="id"),
        "near": models.KnnClassifier(k=5, id_col="id", weights="distance"),
        "ada": boosting.AdaBoost(rounds=12),
        "fourier": models.rff_classifier(gamma=0.5, dims=128),
        "extra": models.extra_trees(trees=20),
        "vote": ensemble.SoftVote(
            {"forest": models.forest_classifier(trees=10), "bayes": models.gaussian_nb()},
            [3.0, 1.0]),
        "bag": ensemble.Bagging(models.tree_classifier(depth=6), 4, 0.75, "id"),
    }[name]
    scored = est.fit(labelled).transform(labelled)
    assert scored.agg(stats.accuracy()).first()[0] >= at_least
    shares = scored.select(vector_to_array("probability").alias("p")).select(
        (F.col("p")[0] + F.col("p")[1]).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert shares == pytest.approx((1.0, 1.0))


def test_out_of_fold_never_sees_its_row(labelled):
    """A single neighbour knows every fitted row by heart, so only unseen rows are missed."""
    knn = {"knn": models.KnnClassifier(k=1, id_col="id")}
    noisy = labelled.withColumn("label", (F.xxhash64("id") % 2 == 0).cast("double"))
    scored = ensemble.out_of_fold(knn, noisy, 3, classify=True)
    assert scored.count() == 300
    hit = scored.agg(F.avg((F.col("score_knn")[1] == F.col("label")).cast("int"))).first()[0]
    assert 0.3 < hit < 0.7


def test_bag_sizes_follow_the_fraction(spark):
    drawn = ensemble.Bagging(None, 1, 0.75, "id").sample(spark.range(20_000), 0)
    assert drawn.count() == pytest.approx(15_000, rel=0.03)
    assert sorted(drawn.collect()) == sorted(
        ensemble.Bagging(None, 1, 0.75, "id").sample(spark.range(20_000).repartition(3), 0).collect())


def test_stacks(labelled, line):
    stack = ensemble.StackClassifier(
        {"forest": models.forest_classifier(trees=10), "bayes": models.gaussian_nb()},
        key="id", folds=3)
    model = stack.fit(labelled)
    assert model.transform(labelled).agg(stats.accuracy()).first()[0] >= 0.9
    _, y, df = line
    regressor = ensemble.StackRegressor({"ridge": linear.Ridge(), "poly": linear.PolyRidge()},
                                        key="id", folds=4)
    error = regressor.fit(df).transform(df).agg(stats.rmse()).first()[0]
    assert error < 0.5 * y.std()


def test_bake_off_scores_every_fold(labelled):
    table = ensemble.bake_off(
        {"tree": models.tree_classifier(), "bayes": models.gaussian_nb()}, labelled,
        stats.accuracy, 3)
    assert table.count() == 6
    best = {r["model"]: r["mean_pct"] for r in stats.cv_summary(table).collect()}
    assert best["tree"] > 80 and best["bayes"] > 80


def test_pseudo_labels_need_enough_sure_rows(labelled):
    half = labelled.withColumn("label", F.when(F.col("id") < 200, F.col("label")))
    tree = models.tree_classifier(depth=4)
    eager = ensemble.PseudoLabel(tree, threshold=0.9, min_rows=10)
    first = tree.fit(half.where("label IS NOT NULL"))
    sure = eager.confident(first, half)
    assert sure.where("id < 200").count() == 0 and sure.count() > 10
    assert eager.fit(half).transform(half).count() == 300
    shy = ensemble.PseudoLabel(tree, threshold=0.9, min_rows=10**6).fit(half)
    assert shy.toDebugString == first.toDebugString


def test_clean_then_fit_drops_two_percent(cloud):
    pre = scale.IqrScaler(cols=["x", "y"])
    stage = outlier.CleanThenFit(
        pre, outlier.IsolationForest(cols=["x", "y"], id_col="id"), linear.Ridge())
    kept = stage.clean(cloud)
    assert kept.columns == cloud.columns
    assert 995 <= kept.count() <= 1005
    assert kept.agg(F.max("x")).first()[0] < 25


def test_huber_boost_resists_outliers(line):
    _, y, df = line
    wild = df.withColumn("label", F.when(F.col("id") == 3, 1000.0).otherwise(F.col("label")))
    model = boosting.HuberBoost(rounds=15, step=0.3, min_rows=3, subset="all").fit(wild)
    scored = model.transform(df).where("id <> 3")
    assert scored.agg(stats.rmse()).first()[0] < y.std()


def test_log_target_returns_the_original_scale(line):
    _, y, df = line
    positive = df.withColumn("label", F.exp(F.col("label") / 4))
    scored = ensemble.LogTarget(linear.Ridge(alpha=0.1)).fit(positive).transform(positive)
    assert scored.agg(F.min("prediction")).first()[0] > -1


def test_failing_solver_answers_zero(spark):
    problems = spark.createDataFrame([("a", "12"), ("b", "x"), ("c", "999999")],
                                     "id string, problem string")
    found = {r["id"]: r["answer"] for r in answers.answer_problems(problems, int).collect()}
    assert found == {"a": 12, "b": 0, "c": 99999}


def test_draws_follow_the_rate(spark):
    for rate in (0.5, 1.0, 20.0, 300.0):
        rows = spark.range(4000).select(ensemble.poisson_copies(F.col("id"), rate, 3).alias("n"))
        mean, spread, most = rows.agg(F.avg("n"), F.variance("n"), F.max("n")).first()
        assert mean == pytest.approx(rate, rel=0.06) and spread == pytest.approx(rate, rel=0.2)
        assert most > rate + 2 * rate**0.5


def test_dummies_of_many_categories(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    assert len(encode.Dummies(cols=["c"]).fit(df).columns()) == 1499


def test_family_scale_is_a_table(spark):
    df = frame(
        spark, [("A, Mr. B", "male", k, 0, None) for k in (0, 8, 9, 10, 11)],
        "Name string, Sex string, SibSp int, Parch int, Cabin string",
    )
    short = blocks.PassengerBlock(family_scale=FAMILY_SCALE_SHORT).transform(df)
    assert values(short, "family_scale") == [(0.0,), (3.2,), (0.0,), (3.6,), (0.0,)]
    assert values(blocks.PassengerBlock().transform(df), "family_scale") == [(0.0,), (3.2,), (3.6,), (4.0,), (0.0,)]


class _Meeting(Estimator):
    """Learns the mean once another fold is being fitted as well."""

    def __init__(self, barrier):
        super().__init__()
        self.barrier = barrier

    def _fit(self, df):
        if self.barrier is not None:
            self.barrier.wait(60)
        mean = df.agg(F.avg("label")).first()[0]
        return SQLTransformer(statement=f"SELECT *, CAST({mean} AS DOUBLE) AS prediction FROM __THIS__")


def test_folds_are_fitted_side_by_side(spark):
    rows = spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("fold"), F.col("id").cast("double").alias("label"))
    scored = ensemble.out_of_fold({"mean": _Meeting(Barrier(3))}, rows, 3, classify=False)
    means = {r["fold"]: r["m"] for r in scored.groupBy("fold").agg(F.max("score_mean").alias("m")).collect()}
    assert means == {fold: sum(k for k in range(30) if k % 3 != fold) / 20 for fold in range(3)}
    assert scored.count() == 30
