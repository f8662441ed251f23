"""Own trees, machines and target statistics against brute force."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabforge.plans import boosting, ensemble, extratrees, histboost, histogram, kernels, linear, models, rowblocks, targets, trees


def table(spark, x, y, parts=3):
    rows = [(k, a.tolist(), None if b is None else float(b)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label").repartition(parts)


@pytest.fixture(scope="module")
def waves():
    random = np.random.default_rng(5)
    x = np.column_stack([random.normal(size=600).round(1), random.integers(0, 4, 600), random.normal(size=600).round(2)])
    return x, np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + random.normal(size=600) * 0.1


def nodes_of(model):
    return model.tables["nodes"].toPandas().sort_values(["tree", "node"])


def scores(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])


# --- histogram boosting -------------------------------------------------------------------


def one_by_one(bins, g, h, leaves, l2, min_rows, depth=99):
    """Best-first growth, one leaf after the other: (gains in order, value per row)."""

    def best(rows, level):
        if level >= depth or len(rows) < 2 * min_rows:
            return None
        found = None
        for f in range(bins.shape[1]):
            for cut in range(int(bins[:, f].max())):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(left), len(right)) < max(1, min_rows):
                    continue
                worth = [g[r].sum() ** 2 / (h[r].sum() + l2) for r in (left, right, rows)]
                gain = worth[0] + worth[1] - worth[2]
                if found is None or gain > found[0] + 1e-9:
                    found = (gain, left, right)
        return found if found and found[0] > 1e-9 else None

    open_leaves = [(np.arange(len(g)), 0)]
    done, gains = [], []
    while open_leaves and len(open_leaves) + len(done) < leaves:
        tried = [best(*leaf) for leaf in open_leaves]
        if not any(tried):
            break
        k = max((k for k, t in enumerate(tried) if t), key=lambda k: tried[k][0])
        gain, left, right = tried[k]
        level = open_leaves.pop(k)[1] + 1
        open_leaves += [(left, level), (right, level)]
        gains.append(gain)
    value = np.zeros(len(g))
    for rows, _ in open_leaves:
        value[rows] = -g[rows].sum() / (h[rows].sum() + l2)
    return gains, value


def binned(x):
    return np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T])


@pytest.mark.parametrize("leaves, depth, l2, min_rows", [(8, None, 0.0, 20), (31, None, 2.0, 5), (16, 3, 0.5, 1), (2, None, 0.0, 1)])
def test_leafwise_trees_are_those_of_one_by_one_growth(spark, waves, leaves, depth, l2, min_rows):
    x, y = waves
    model = histboost.HistBoost(rounds=2, step=0.5, leaves=leaves, depth=depth, l2=l2, min_rows=min_rows).fit(table(spark, x, y))
    score = np.full(len(y), y.mean())
    for k in range(2):
        gains, value = one_by_one(binned(x), score - y, np.ones(len(y)), leaves, l2, min_rows, depth or 99)
        assert np.allclose([s[2] for s in model.splits[k]], gains, rtol=1e-6)
        score += 0.5 * value
    assert np.allclose(scores(model, table(spark, x, y)), score, atol=1e-6)
    ends = nodes_of(model).query("feature == -1")
    assert ends.groupby("tree").size().max() <= leaves


def test_logistic_boosting(spark, waves):
    x, y = waves
    label = (y > 0.5).astype(float)
    model = histboost.HistBoost(loss="logistic", rounds=2, step=0.3, leaves=6, l2=1.0).fit(table(spark, x, label))
    score = np.full(len(y), np.log(label.mean() / (1 - label.mean())))
    for k in range(2):
        p = 1 / (1 + np.exp(-score))
        gains, value = one_by_one(binned(x), p - label, p * (1 - p), 6, 1.0, 20)
        assert np.allclose([s[2] for s in model.splits[k]], gains, rtol=1e-5)
        score += 0.3 * value
    out = model.transform(table(spark, x, label)).orderBy("id").select(vector_to_array("probability")[1], "prediction").collect()
    assert np.allclose([r[0] for r in out], 1 / (1 + np.exp(-score)), atol=1e-6)
    assert [r[1] for r in out] == [float(s > 0) for s in score]


def test_symmetric_trees(spark, waves):
    x, y = waves
    model = histboost.HistBoost(shape="symmetric", depth=3, rounds=1, step=1.0, l2=1.0, min_rows=1).fit(table(spark, x, y))
    bins, g = binned(x), y.mean() - y
    part = np.zeros(len(y), dtype=int)
    for level in range(3):
        def worth(codes):
            return sum(g[codes == c].sum() ** 2 / ((codes == c).sum() + 1.0) for c in np.unique(codes))
        cuts = [(f, c) for f in range(3) for c in range(int(bins[:, f].max()))]
        gains = [worth(2 * part + (bins[:, f] > c)) - worth(part) for f, c in cuts]
        f, c = cuts[int(np.argmax(gains))]
        assert np.isclose(model.splits[0][level][2], max(gains), rtol=1e-6)
        part = 2 * part + (bins[:, f] > c)
    value = {p: -g[part == p].sum() / ((part == p).sum() + 1.0) for p in np.unique(part)}
    assert np.allclose(scores(model, table(spark, x, y)), y.mean() + np.array([value[p] for p in part]), atol=1e-6)
    levels = nodes_of(model)
    inner = levels[levels["feature"] >= 0]
    assert len(inner.groupby(["feature", "threshold"])) <= 3


def test_boosting_does_not_depend_on_partitions_blocks_or_settling(spark, waves, monkeypatch):
    x, y = waves
    kw = dict(rounds=6, leaves=7, rows_share=0.6, columns_share=0.7, key="id", bins=16)
    expected = nodes_of(histboost.HistBoost(**kw).fit(table(spark, x, y, 1)))
    monkeypatch.setattr(histogram, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(histogram, "DRIVER_BYTES", 0)
    monkeypatch.setattr(histogram, "SLICE", 8)
    monkeypatch.setattr(histogram, "AT_ONCE", 100)
    monkeypatch.setattr(histboost, "SETTLE_EVERY", 2)
    again = nodes_of(histboost.HistBoost(**kw).fit(table(spark, x, y, 7)))
    pd.testing.assert_frame_equal(expected.reset_index(drop=True), again.reset_index(drop=True))


@pytest.mark.parametrize("kw", [
    dict(rounds=4, leaves=7, rows_share=0.6, columns_share=0.7, key="id", bins=16),
    dict(rounds=4, leaves=7, loss="logistic", min_weight=0.1),
    dict(rounds=3, shape="symmetric", depth=3, l2=1.0, min_rows=1),
])
def test_trees_of_one_task_are_those_of_passes(spark, waves, monkeypatch, kw):
    x, y = waves
    wide = np.column_stack([x, np.random.default_rng(1).integers(0, 9, len(x))[:, None] == np.arange(9)])
    df = table(spark, wide, y > y.mean() if "loss" in kw else y)
    held = histboost.HistBoost(**kw).fit(df)
    monkeypatch.setattr(histboost, "histograms", None)  # no pass is needed
    again = histboost.HistBoost(**kw).fit(df)
    monkeypatch.undo()
    monkeypatch.setattr(histboost, "HELD_BYTES", 0)
    monkeypatch.setattr(histboost, "SETTLE_EVERY", 2)
    dealt = histboost.HistBoost(**kw).fit(df)
    assert held.splits == again.splits == dealt.splits
    pd.testing.assert_frame_equal(nodes_of(held).reset_index(drop=True), nodes_of(dealt).reset_index(drop=True))


def test_sums_of_noted_bins_are_those_of_all_bins():
    random = np.random.default_rng(3)
    x = np.column_stack([random.integers(0, 5, 400), (random.random((400, 6)) < 0.1).astype(int), np.zeros(400, dtype=int)]).astype("uint8")
    offsets = np.concatenate([[0], np.cumsum(x.max(axis=0).astype(int) + 1)])
    usual, codes = histogram.sparse_codes(x, offsets)
    assert len(codes) < x.shape[1]
    rows, slot = np.arange(0, 400, 2), random.integers(0, 3, 200)
    values = [random.integers(-1000, 1000, 400).astype(float), np.full(400, 7.0), np.ones(400)]
    found = histogram.code_sums(codes, usual, offsets, rows, slot, 3, values)
    for node in range(3):
        for k, value in enumerate(values):
            own = rows[slot == node]
            expected = [value[own][x[own, f] == b].sum() for f in range(x.shape[1]) for b in range(offsets[f + 1] - offsets[f])]
            assert found[node, k].tolist() == expected


def test_bins_cut_in_one_task_are_the_quantiles(spark, monkeypatch):
    random = np.random.default_rng(4)
    x = np.column_stack([random.normal(size=500), random.integers(0, 40, 500) ** 2, random.integers(0, 3, 500), np.full(500, 2.0)])
    x[::7, 0] = np.nan
    x[::5, 1] = -0.0
    rows = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>").repartition(4)
    found = histogram.bin_edges(rows, 16)
    monkeypatch.setattr(histogram, "TASK_VALUES", 0)
    for own, by_ranks in zip(found, histogram.bin_edges(rows, 16), strict=True):
        assert own.tolist() == by_ranks.tolist()


def test_boost_presets_train_their_published_rounds(spark, monkeypatch):
    from tabforge.catalog import ensembles

    asked = {}

    def note(bases, df):
        asked.update(bases)
        raise InterruptedError

    monkeypatch.setattr(ensembles.ensemble, "fit_all", note)
    with pytest.raises(InterruptedError):
        ensembles.boost_presets(spark, "/root/testdata/sf0.001")
    rounds = {name: est.get("rounds") for name, est in asked.items() if name != "forest"}
    assert rounds == {"sampled": 2000, "leafwise": 1000, "target_encoded": 1500}


@pytest.mark.parametrize("module, est", [
    (extratrees, extratrees.ExtraTrees(trees=5, depth=6, min_rows=2)),
    (boosting, boosting.AdaBoost(rounds=8)),
    (kernels, kernels.FourierClassifier(dims=12, rounds=8)),
    (kernels, kernels.FourierRegressor(dims=12, rounds=8, gamma=0.1)),
])
def test_fits_of_one_task_are_those_of_passes(spark, waves, monkeypatch, module, est):
    x, y = waves
    df = table(spark, x, y if "Regressor" in type(est).__name__ else y > y.mean())
    passes, gathered = [], module.gathered

    def counted(blocks, *rest, **named):
        passes.append(blocks)
        return gathered(blocks, *rest, **named)

    monkeypatch.setattr(module, "gathered", counted)
    held = est.fit(df)
    assert not passes  # all in tasks
    monkeypatch.setattr(module, "HELD_BYTES", 0)
    dealt = est.fit(df)
    assert passes
    if module is extratrees:
        a, b = (nodes_of(m).reset_index(drop=True) for m in (held, dealt))
        assert [list(v) for v in a.pop("value")] == [list(v) for v in b.pop("value")]
        pd.testing.assert_frame_equal(a, b)
    elif module is boosting:
        assert (held.get("stumps"), held.get("votes")) == (dealt.get("stumps"), dealt.get("votes"))
    else:
        assert np.allclose(held.get("weights"), dealt.get("weights"), rtol=1e-6, atol=1e-9)


def test_samples_are_shares(spark, waves):
    x, y = waves
    mark = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 100_000)
    for share in (0.1, 0.7):
        assert abs(histogram.kept(mark, share, 3).mean() - share) < 0.01
    assert (histogram.kept(mark, 0.5, 3) != histogram.kept(mark, 0.5, 4)).mean() > 0.4


def test_boosting_odd_tables(spark, waves):
    x, y = waves
    empty = histboost.HistBoost().fit(table(spark, x[:0], y[:0]))
    assert scores(empty, table(spark, x[:3], y[:3])).tolist() == [0.0] * 3
    flat = histboost.HistBoost(rounds=3).fit(table(spark, np.ones((50, 2)), np.full(50, 4.0)))
    assert scores(flat, table(spark, x[:3], y[:3])).tolist() == [4.0] * 3
    missing = x.copy()
    missing[::3, 0] = np.nan
    labels = [None if k % 5 == 0 else v for k, v in enumerate(y)]
    gaps = histboost.HistBoost(rounds=5, step=0.5, min_rows=5).fit(table(spark, missing, labels))
    assert np.isfinite(scores(gaps, table(spark, missing, labels))).all()
    huge = histboost.HistBoost(rounds=20, step=1.0, min_rows=5).fit(table(spark, x, 1e9 * y))
    assert np.abs(scores(huge, table(spark, x, y)) - 1e9 * y).mean() < 3e8


def test_bins_of_many_values(spark):
    random = np.random.default_rng(1)
    x = np.column_stack([random.normal(size=3000), random.integers(0, 2, 3000), np.zeros(3000)])
    df = table(spark, x, x[:, 0]).select(vector_to_array("features").alias("x"))
    edges = histogram.bin_edges(df, 16)
    assert len(edges[0]) == 15 and edges[1].tolist() == [0.0] and not len(edges[2])
    counts = np.bincount(np.searchsorted(edges[0], x[:, 0], side="left"))
    assert len(counts) == 16 and counts.min() > 150 and counts.max() < 220


# --- tables of trees ----------------------------------------------------------------------


def test_a_thousand_trees_score_at_once_and_save(spark, waves, tmp_path):
    x, y = waves
    rows = []
    for tree in range(1000):
        rows += [(tree, 0, tree % 3, tree / 500 - 1, 1, 2, [0.0]), (tree, 1, -1, 0.0, -1, -1, [1.0]), (tree, 2, -1, 0.0, -1, -1, [2.0])]
    model = trees.TreeModel(tables={"nodes": trees.node_table(spark, rows)}, start=0.5)
    df = table(spark, x[:500], y[:500]).cache()
    df.count()
    began = time.time()
    found = scores(model, df)
    assert time.time() - began < 10
    plain = [0.5 + sum(2.0 if r[t % 3] > t / 500 - 1 else 1.0 for t in range(1000)) for r in x[:500]]
    assert found.tolist() == plain
    model.save(str(tmp_path / "m"))
    assert scores(trees.TreeModel.load(str(tmp_path / "m")), df).tolist() == plain


def test_huber_and_stumps_flatten(spark, waves, tmp_path):
    x, y = waves
    df = table(spark, x, y)
    huber = boosting.HuberBoost(rounds=12, step=0.3).fit(df)
    assert np.sqrt(np.mean((scores(huber, df) - y) ** 2)) < 0.8 * y.std()
    huber.save(str(tmp_path / "h"))
    assert np.array_equal(scores(trees.TreeModel.load(str(tmp_path / "h")), df), scores(huber, df))
    classes = table(spark, x, (y > 0.5).astype(float))
    ada = boosting.AdaBoost(rounds=8).fit(classes)
    guess = np.zeros(len(y))
    for (feature, threshold, below, above), vote in zip(ada.get("stumps"), ada.get("votes")):
        guess += vote * np.where(np.where(x[:, int(feature)] > threshold, above, below) == 1.0, 1, -1)
    assert np.array_equal(scores(ada, classes), (guess > 0).astype(float)) and len(ada.get("votes")) > 3
    ada.save(str(tmp_path / "a"))
    assert np.array_equal(scores(boosting.AdaBoostModel.load(str(tmp_path / "a")), classes), scores(ada, classes))


def test_ensembles_save(spark, waves, tmp_path):
    x, y = waves
    df = table(spark, x, (y > 0.5).astype(float))
    vote = ensemble.SoftVote({"b": models.hist_boost_classifier(rounds=2), "a": models.gaussian_nb()}, [2.0, 1.0]).fit(df)
    stack = ensemble.StackClassifier({"bayes": models.gaussian_nb(), "tree": models.tree_classifier(depth=2)}, key="id", folds=2).fit(df)
    bag = ensemble.Bagging(models.tree_classifier(depth=2), n=2, fraction=0.7, key="id").fit(df)
    for k, model in enumerate((vote, stack, bag)):
        model.save(str(tmp_path / f"{k}"))
        assert np.array_equal(scores(type(model).load(str(tmp_path / f"{k}")), df), scores(model, df))
    numbers = table(spark, x, y + 5)
    log = ensemble.LogTarget(ensemble.StackRegressor({"a": linear.Ridge(), "b": linear.Ridge(alpha=1.0)}, key="id", folds=2)).fit(numbers)
    pipe = PipelineModel(stages=[log])
    pipe.save(str(tmp_path / "log"))
    assert np.allclose(scores(PipelineModel.load(str(tmp_path / "log")), numbers), scores(log, numbers))


# --- extremely randomised trees -----------------------------------------------------------


def test_extra_trees_cut_within_their_nodes(spark, waves, monkeypatch):
    x, y = waves
    label = (y > 0.5).astype(float) + (y > 1.5)
    est = extratrees.ExtraTrees(trees=12, depth=6, min_rows=3, seed=4)
    model = est.fit(table(spark, x, label))
    nodes = nodes_of(model)
    for _, tree in nodes.groupby("tree"):
        at = {0: np.arange(len(x))}
        for n in tree.itertuples():
            rows = at[n.node]
            counts = np.bincount(label[rows].astype(int), minlength=3)
            if n.feature == -1:
                assert np.allclose(n.value, counts / counts.sum()) and len(rows) >= 3
                continue
            own = x[rows, n.feature]
            assert own.min() <= n.threshold < own.max()
            at[n.left], at[n.right] = rows[own <= n.threshold], rows[own > n.threshold]
    assert nodes.groupby("tree")["threshold"].first().nunique() > 6
    out = model.transform(table(spark, x, label))
    assert out.where("prediction = label").count() > 0.65 * len(x)
    monkeypatch.setattr(extratrees, "PASS_BYTES", 1)
    again = nodes_of(est.fit(table(spark, x, label, 5)))
    pd.testing.assert_frame_equal(nodes.reset_index(drop=True), again.reset_index(drop=True))


def test_extra_trees_odd_tables(spark, waves):
    x, y = waves
    one = extratrees.ExtraTrees(trees=2, classes=2).fit(table(spark, x, np.ones(len(x))))
    assert scores(one, table(spark, x, y)).tolist() == [1.0] * len(x)
    extratrees.ExtraTrees(trees=2).fit(table(spark, x[:0], y[:0]))
    same = extratrees.ExtraTrees(trees=2).fit(table(spark, np.ones((20, 2)), np.arange(20) % 2))
    assert same.transform(table(spark, x[:1], y[:1])).select(vector_to_array("probability")).first()[0] == [0.5, 0.5]


# --- machines -----------------------------------------------------------------------------


def test_tube_regression_reaches_the_optimum(spark, waves):
    x, y = waves
    df = table(spark, x, y)
    est = kernels.FourierRegressor(gamma=0.2, c=5.0, epsilon=0.1, dims=40, rounds=200)
    model = est.fit(df)
    assert model.get("reached") <= 1e-3
    z = kernels.fourier(x, 0.2, 40, 42)
    w = np.array(model.get("weights"))

    def cost(v):
        return v[:-1] @ v[:-1] / 2 + 5.0 * np.maximum(0, np.abs(y - z @ v) - 0.1).sum()

    # Subgradient steps from the solution find nothing that is better by more than the gap.
    best, v = cost(w), w.copy()
    for k in range(3000):
        r = y - z @ v
        slope = np.append(v[:-1], 0.0) - 5.0 * z.T @ (np.sign(r) * (np.abs(r) > 0.1))
        v = v - 1e-3 / (1 + k) ** 0.6 * slope / max(np.linalg.norm(slope), 1e-12)
        best = min(best, cost(v))
    assert best >= cost(w) * (1 - 1.1e-3)
    assert np.allclose(scores(model, df), z @ w)
    # Labels moved inside the tube cost nothing: the same fit explains them with no loss.
    wide = kernels.FourierRegressor(gamma=0.2, c=5.0, epsilon=10.0, dims=40).fit(df)
    assert np.abs(np.array(wide.get("weights"))[:-1]).max() < 1e-6


def test_classifier_probabilities_are_calibrated(spark, tmp_path):
    random = np.random.default_rng(8)
    x = random.normal(size=(900, 2))
    chance = 1 / (1 + np.exp(-4 * (1.2 - (x**2).sum(axis=1))))
    label = (random.random(900) < chance).astype(float)
    df = table(spark, x, label)
    model = kernels.FourierClassifier(gamma=0.5, c=1.0, dims=60, rounds=150).fit(df)
    assert model.get("reached") <= 2e-3 and model.get("slope") > 0
    rows = model.transform(df).orderBy("id").select(vector_to_array("probability")[1], "prediction").collect()
    p = np.array([r[0] for r in rows])
    assert np.abs(p - chance).mean() < 0.1
    for low in (0.0, 0.25, 0.75):
        own = (p >= low) & (p < low + 0.25)
        assert abs(label[own].mean() - p[own].mean()) < 0.12
    # The same machine by a direct solver: subgradients on the hinge, from nought.
    z, y = kernels.fourier(x, 0.5, 60, 42), 2 * label - 1

    def cost(v):
        return v[:-1] @ v[:-1] / 2 + np.maximum(0, 1 - y * (z @ v)).sum()

    v, best = np.zeros(61), np.inf
    for k in range(6000):
        slope = np.append(v[:-1], 0.0) - z.T @ (y * (y * (z @ v) < 1))
        v = v - 0.5 / (1 + k) ** 0.7 * slope / max(np.linalg.norm(slope), 1e-12)
        best = min(best, cost(v))
    w = np.array(model.get("weights"))
    assert cost(w) <= best * 1.003
    model.save(str(tmp_path / "k"))
    again = kernels.FourierModel.load(str(tmp_path / "k")).transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()
    assert np.allclose(p, [r[0] for r in again])


def test_machines_on_one_class_and_nothing(spark, waves):
    x, y = waves
    one = kernels.FourierClassifier(dims=8).fit(table(spark, x, np.ones(len(x))))
    assert scores(one, table(spark, x[:5], y[:5])).tolist() == [1.0] * 5
    none = kernels.FourierRegressor(dims=8).fit(table(spark, x[:0], y[:0]))
    assert scores(none, table(spark, x[:5], y[:5])).tolist() == [0.0] * 5


# --- target statistics --------------------------------------------------------------------


def test_ordered_targets(spark, tmp_path):
    rows = [(k, ["a", "b", None][k % 3] if k % 7 else "rare", float(k % 5) if k % 11 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, kind string, label double").repartition(3)
    est = targets.OrderedTargets(cols=["kind"], key="id", weight=2.0)
    known = [r for r in rows if r[2] is not None]
    prior = sum(r[2] for r in known) / len(known)
    drawn = dict(df.select("id", targets.hash32(F.col("id"), 42)).collect())
    for part in (1_000_000, 20):
        got = {r["id"]: r["kind_target"] for r in est.training(df, part).collect()}
        for i, kind, _ in known:
            before = [y for j, other, y in known if other == kind and (drawn[j], j) < (drawn[i], i)]
            assert np.isclose(got[i], (sum(before) + 2 * prior) / (len(before) + 2))
        assert len(got) == len(known)
    model = est.fit(df)
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "new")], "id long, kind string")
    model.save(str(tmp_path / "t"))
    for m in (model, targets.OrderedTargetsModel.load(str(tmp_path / "t"))):
        out = {r["id"]: r["kind_target"] for r in m.transform(new).collect()}
        own = {k: [y for _, other, y in known if other == k] for k in ("a", None)}
        assert np.isclose(out[1], (sum(own["a"]) + 2 * prior) / (len(own["a"]) + 2))
        assert np.isclose(out[2], (sum(own[None]) + 2 * prior) / (len(own[None]) + 2)) and np.isclose(out[3], prior)


def test_target_encoded_boost(spark):
    random = np.random.default_rng(3)
    rows = [(k, int(c), float(z), float(c % 7 + z + random.normal() * 0.1)) for k, (c, z) in enumerate(zip(random.integers(0, 40, 800), random.random(800)))]
    df = spark.createDataFrame(rows, "id long, kind_index int, z double, label double").withColumn("kind_index", F.col("kind_index").cast("double"))
    df = VectorAssembler(inputCols=["z"], outputCol="features").transform(df)
    model = Pipeline(stages=[models.boost_preset("target_encoded", rounds=10, step=0.4, depth=4, key="id")]).fit(df)
    error = model.transform(df).select(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]
    assert error < 0.75


def test_blocks_are_dealt_to_tasks(spark):
    # All rows in one part, as after a small shuffle: every task still gets its share.
    rows = spark.range(0, 20_000, 1, 1).select(
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), F.lit(1.0).alias("label"), F.lit(1.0).alias("weight"), F.col("id").alias("mark")
    )
    edges = [np.arange(100.0), np.zeros(0)]
    for blocks in (rowblocks.raw_blocks(rows, 20_000, 2), histogram.pack_rows(rows, 20_000, edges, 0.0)):
        held = blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
        assert sum(r.n for r in held) == 20_000 and len(held) >= 5 and max(r.n for r in held) <= 8_000
