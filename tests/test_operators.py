import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.operators import circles, columns, lookup, order, stats
from tabforge.operators.neighbors import knn_join
from tabforge.operators import neighbors
from tabforge.operators.order import stratified_kfold
from tabforge.operators.quantiles import medians, quantiles


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(
        [(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None), (None, None)],
        "x double, c string",
    )


def test_exact_statistics(ties):
    assert medians(ties, ["x"]).first()[0] == 3.0
    assert quantiles(ties, ["x"], [0.99]).first()[0][0] == pytest.approx(9.82)
    assert stats.modes(ties, ["c", "x"]) == {"c": "a", "x": 1.0}
    population = stats.skewness(ties, ["x"], adjusted=False).first()["skew"]
    adjusted = stats.skewness(ties, ["x"], adjusted=True).first()["skew"]
    assert (population, adjusted) == (pytest.approx(0.84832, abs=1e-5),
                                      pytest.approx(1.46933, abs=1e-5))


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_quantiles_do_not_depend_on_the_parts(spark, keys):
    """A third of all rows share one value, half of the rows share one key."""
    random.seed(3)
    rows = [
        (random.choice(["hot", "hot", "a", "b"]),
         None if i % 13 == 0 else 5.0 if i % 3 == 0 else random.gauss(0, 10) ** 3,
         float(i % 7))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.501, 0.99, 1.0]

    def table(limit):
        found = quantiles(df, ["x", "y"], probs, keys, rows_per_part=limit)
        return {tuple(r[k] for k in keys): (r["x"], r["y"]) for r in found.collect()}

    small, large, mixed = table(10**6), table(10), table(900)
    assert small.keys() == large.keys() == mixed.keys()
    for key, found in small.items():
        assert large[key] == mixed[key] == found
    whole = df if not keys else df.groupBy(*keys)
    plain = whole.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "xy"])
    assert {tuple(r[k] for k in keys): (r["x"], r["y"]) for r in plain.collect()} == small


@pytest.mark.parametrize("part", [2, 10**6])
def test_quantiles_of_odd_groups(spark, part):
    inf = float("inf")
    rows = [("a", 1.0, None), ("a", inf, None), ("a", 3.0, None), ("b", None, 1.0), ("b", None, 2.0), ("c", -inf, 5.0)]
    rows += [(f"hot{k}", 1e-9 * (i % 3), None) for k in range(40) for i in range(9)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    found = {r.k: (r.x, r.y) for r in quantiles(df, ["x", "y"], [0.0, 0.5, 1.0], ["k"], rows_per_part=part).collect()}
    assert found["a"] == ([1.0, 3.0, inf], None) and found["b"] == (None, [1.0, 1.5, 2.0])
    assert found["c"] == ([-inf] * 3, [5.0] * 3) and found["hot7"] == ([0.0, 1e-9, 2e-9], None)
    assert len(found) == 43
    nothing = quantiles(df.select("k", "x", F.lit(None).cast("double").alias("z")), ["x", "z"], [0.5], rows_per_part=part)
    assert nothing.first().z is None
    assert medians(df.limit(0), ["x"]).first()[0] is None and medians(df.limit(0), ["x"], ["k"]).collect() == []


def test_rows_without_a_label_keep_their_fold(spark):
    rows = [(k, None if k % 4 == 0 else k % 3) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, label int")
    folds = stratified_kfold(df, "id", "label", 5, 1, rows_per_part=30)
    found = folds.groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in found) == 100
    assert all(r["count"] == 5 for r in found if r.label is None)


def test_fill_keeps_rows_and_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", None), (5, None, None)],
        "id int, g string, x double",
    )
    filled = {r["id"]: r["x"] for r in lookup.fill_group_median(df, ["g"], "x").collect()}
    assert filled == {1: 1.0, 2: 3.0, 3: 2.0, 4: None, 5: None}
    by_mode = lookup.fill_from_group_mode(df, "g", "x").columns
    assert by_mode == df.columns


def test_filters(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id int, x double")
    assert [r["id"] for r in columns.filter_below(df, "x", 50).collect()] == [1]
    assert columns.exclude_ids(df, "id", [1, 9]).count() == 2
    with pytest.raises(ValueError):
        columns.drop_cols(df, ["nope"])
    assert columns.drop_cols(df, ["nope", "x"], tolerant=True).columns == ["id"]
    assert columns.present_or_first(df, ["nope"]) == ["id", "x"]


def test_running_total_is_the_same_in_many_parts(spark):
    rows = [(i % 700, i) for i in range(3000)] + [(5, 1)] * 1000  # one heavily repeated value
    df = spark.createDataFrame(rows, "day int, n int")
    one = order.running_total(df, "day", "n").collect()
    many = order.running_total(df, "day", "n", rows_per_part=40).collect()
    assert sorted(one) == sorted(many)
    per_day = pd.DataFrame(rows, columns=["day", "n"]).groupby("day")["n"].sum()
    before = (per_day.cumsum() - per_day).to_dict()
    assert {r["day"]: r["total_before"] for r in many} == before


def test_recurrence_closed_form(spark):
    df = spark.range(1, 2025).select(F.col("id").alias("n"), F.col("id").alias("m"))
    total = order.running_total(df, "n", "m", rows_per_part=100)
    last = total.where("n = 2024").first()
    assert last["total_before"] + 1 == 2_047_277


def test_codes_in_sorted_order(spark):
    df = spark.createDataFrame([(c,) for c in "dbcabz" + "a" * 50] + [(None,)], "c string")
    for size in (100, 2):
        codes = order.category_codes(df, "c", rows_per_part=size)
        assert {r["c"]: r["code"] for r in codes.collect()} == dict(zip("abcdz", range(5)))


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    one = order.stratified_kfold(df, "id", "label", 5, 1)
    many = order.stratified_kfold(df.repartition(7), "id", "label", 5, 1, rows_per_part=50)
    assert sorted(one.collect()) == sorted(many.collect())
    sizes = one.groupBy("label", "fold").count().collect()
    assert {r["count"] for r in sizes if r["label"] == 1} == {20}
    assert {r["count"] for r in sizes if r["label"] == 0} == {180}
    folds = order.kfold(df, "id", 5, 1)
    assert sorted(folds.collect()) == sorted(order.kfold(df.repartition(3), "id", 5, 1).collect())


def _brute_force_circles(rows):
    counts = {}
    for i, x, y, r in rows:
        touch = cross = 0
        for j, u, v, s in rows:
            gap, outer, inner = (x - u) ** 2 + (y - v) ** 2, (r + s) ** 2, (r - s) ** 2
            if i == j or (gap == 0 and r == s) or r <= 0 or s <= 0:
                continue
            touch += gap in (outer, inner)
            cross += inner < gap < outer
        counts[i] = (touch, cross)
    return counts


def test_circles(spark, monkeypatch):
    rows = [(0, 2.0, 3.0, 5.0), (1, 8.0, 11.0, 10.0), (2, 0.0, 0.0, 1.0), (3, 2.0, 0.0, 1.0),
            (4, 0.0, 0.0, 1.0), (5, 0.0, 0.0, 500.0), (6, 1.0, 1.0, 0.0)]
    random.seed(1)
    rows += [(i, float(random.randint(-60, 60)), float(random.randint(-60, 60)),
              float(random.choice([1, 1, 2, 5, 13]))) for i in range(7, 300)]
    rows += [(i, 3.0, 4.0, 5.0) for i in range(300, 420)]  # many copies of one circle
    df = spark.createDataFrame(rows, "id int, x double, y double, r double")
    expected = _brute_force_circles(rows)
    for tile in (1000, 7):
        monkeypatch.setattr(circles, "TILE_ROWS", tile)
        found = circles.circle_intersections(df).collect()
        assert {r["id"]: (r["n_touch"], r["n_cross"]) for r in found} == expected


def _brute_force_neighbours(receivers, donors, k):
    found = []
    for rid, target, space, scale, vec in receivers:
        near = sorted(
            (float(np.sum(np.square(np.subtract(vec, other)))) * scale, did, payload)
            for did, other_space, other, payload in donors
            if other_space == space
        )
        found += [(rid, target, did, payload, distance) for distance, did, payload in near]
    best = pd.DataFrame(found, columns=["rid", "target", "did", "payload", "distance2"])
    best = best.sort_values(["distance2", "did"]).groupby(["rid", "target"]).head(k)
    return {(r.rid, r.target, r.did): (r.payload, round(r.distance2, 9))
            for r in best.itertuples()}


@pytest.mark.parametrize("tile", [20_000, 9])
def test_neighbours_against_brute_force(spark, monkeypatch, tile):
    """A third of the donors are copies of one point; whole-number features make many ties."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", tile)
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", tile)
    monkeypatch.setattr(neighbors, "DONORS_PER_PIVOT", tile)
    rng = np.random.default_rng(5)
    donors = [(i, "s" if i % 2 else "t",
               [7.0, 7.0, 7.0] if i % 3 == 0 else rng.integers(0, 12, 3).astype(float).tolist(),
               float(i)) for i in range(600)]
    donors += [(900 + i, "far", [float(1000 * i), 0.0, 0.0], 1.0) for i in range(3)]
    receivers = [(i, target, space, scale, rng.integers(0, 12, 3).astype(float).tolist())
                 for i in range(40)
                 for target, space, scale in (("x", "s", 1.5), ("x", "t", 1.0), ("y", "far", 1.0),
                                              ("z", "empty", 1.0))]
    found = knn_join(
        spark.createDataFrame(
            receivers, "rid long, target string, space string, scale double, vec array<double>"),
        spark.createDataFrame(
            donors, "did long, space string, vec array<double>, payload double"),
        6,
    ).collect()
    got = {(r["rid"], r["target"], r["did"]): (r["payload"], round(r["distance2"], 9))
           for r in found}
    assert got == _brute_force_neighbours(receivers, donors, 6)


def test_profile_and_histogram(spark, ties):
    counts = {r["column"]: (r["n_present"], r["n_missing"]) for r in stats.profile(ties).collect()}
    assert counts == {"x": (4, 2), "c": (4, 2)}
    shares = stats.class_histogram(ties, "c", "x", 2, 0.0, 8.0).collect()
    assert {(r["c"], r["bin"]): r["share"] for r in shares} == {
        ("a", 1): 0.5, ("a", 3): 0.5, ("b", 1): 0.5, ("b", 2): 0.5}


def test_rows_of_few_groups_are_not_sorted_for_a_lookup(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).cast("double").alias("v"))
    filled = lookup.fill_group_median(rows, ["g"], "v")
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few = sorted(map(tuple, filled.collect()))
    assert len(few) == 3000 and all(v is not None for _, v in few)
    monkeypatch.setattr(lookup, "FEW_GROUPS", 2)
    assert sorted(map(tuple, lookup.fill_group_median(rows, ["g"], "v").collect())) == few


def test_nearest_of_a_tile_are_exact():
    """Far from the origin a matrix product is rough: ties and order must not suffer."""
    rng = np.random.default_rng(6)
    for shift in (0.0, 1e6):
        points = rng.integers(0, 3, (200, 20)) + shift
        queries = np.concatenate([points[:20], rng.random((20, 20)) + shift])
        ids = rng.permutation(200)
        query, point, distance = neighbors._nearest(queries, points, ids, 7)
        exact = neighbors._squared(queries, points)
        for at, row in enumerate(exact):
            best = np.lexsort((ids, row))[:7]
            assert point[query == at].tolist() == best.tolist()
            assert distance[query == at].tolist() == row[best].tolist()


def test_receivers_go_out_once_where_blocks_rule_out_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(neighbors, "DONORS_PER_PIVOT", 20)
    sent, compare = spark.sparkContext.accumulator(0), neighbors._compare

    def counted(k, out_columns):
        nearest = compare(k, out_columns)

        def count(donors, receivers):
            sent.add(len(receivers))
            return nearest(donors, receivers)

        return count

    monkeypatch.setattr(neighbors, "_compare", counted)
    donors = [(i, "s", rng.random(50).tolist(), 0.0) for i in range(400)]
    receivers = [(i, "x", "s", 1.0, rng.random(50).tolist()) for i in range(30)]
    found = knn_join(
        spark.createDataFrame(receivers, "rid long, target string, space string, scale double, vec array<double>"),
        spark.createDataFrame(donors, "did long, space string, vec array<double>, payload double"), 6,
    ).collect()
    got = {(r["rid"], r["target"], r["did"]): (r["payload"], round(r["distance2"], 9)) for r in found}
    assert got == _brute_force_neighbours(receivers, donors, 6)
    assert sent.value == 30


def test_few_pairs_are_compared_as_through_blocks(spark, monkeypatch):
    random = np.random.default_rng(8)
    points = random.normal(size=(300, 3)).round(1)
    rows = [(i, "a" if i % 3 else "b", p.tolist(), float(i)) for i, p in enumerate(points)]
    donors = spark.createDataFrame(rows[:200], "did long, space string, vec array<double>, payload double")
    receivers = spark.createDataFrame(
        [(i, "", s if i % 10 else "none", 1.0, v) for i, s, v, _ in rows[100:]], "rid long, target string, space string, scale double, vec array<double>"
    )

    def found():
        return sorted(map(tuple, knn_join(receivers, donors, 4).select("rid", "did", "payload", "distance2", "rank").collect()))

    planned = []
    monkeypatch.setattr(neighbors, "CHUNK_PAIRS", 500)
    monkeypatch.setattr(neighbors, "_pivots", lambda donors, plan=neighbors._pivots: planned.append(1) or plan(donors))
    direct = found()
    assert not planned and len(direct) == 180 * 4
    monkeypatch.setattr(neighbors, "DIRECT_PAIRS", -1)
    assert found() == direct and planned
