"""Whole trainings on invented rows with the raw columns of the three data sets."""

import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import stats
from tabforge.operators.columns import by_split, stack_splits
from tabforge.plans import ensemble, recipes
from tabforge.sources import schemas

QUICK = 0.01


def frame(spark, schema, rows):
    blank = dict.fromkeys(schema.names)
    return spark.createDataFrame([tuple((blank | row)[n] for n in schema.names) for row in rows],
                                 schema)


@pytest.fixture(scope="module")
def manifest_a(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(160):
        female, title = rnd.random() < 0.5, rnd.choice(["Mr", "Master", "Dr"])
        rows.append({
            "PassengerId": i, "Survived": int(female != (rnd.random() < 0.1)),
            "Pclass": rnd.randint(1, 3), "Sex": "female" if female else "male",
            "Name": f"Fam{i % 40}, {'Mrs' if female else title}. Given",
            "Age": None if i % 6 == 0 else float(rnd.randint(1, 80)),
            "SibSp": rnd.randint(0, 2), "Parch": rnd.randint(0, 2), "Ticket": f"T{i}",
            "Fare": None if i == 7 else rnd.expovariate(0.03),
            "Cabin": None if i % 3 else f"{rnd.choice('ABCDEFGT')}{i}",
            "Embarked": None if i == 9 else rnd.choice("SCQ"),
        })
    return frame(spark, schemas.MANIFEST_A, rows).withColumn(
        "label", F.col("Survived").cast("double"))


@pytest.mark.parametrize("version", ["baseline", "voting", "notebook", "stacking"])
def test_manifest_a(manifest_a, version):
    model = recipes.manifest_a(version, effort=QUICK, folds=2).fit(manifest_a)
    scored = model.transform(manifest_a.drop("label", "Survived"))
    assert scored.where("prediction IS NULL").count() == 0 and scored.count() == 160
    joined = scored.select("PassengerId", "prediction").join(
        manifest_a.select("PassengerId", "label"), "PassengerId")
    assert joined.agg(stats.accuracy()).first()[0] > 0.8


@pytest.fixture(scope="module")
def manifest_b(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        asleep = rnd.random() < 0.4
        spend = {c: None if rnd.random() < 0.05 else 0.0 if asleep else rnd.expovariate(0.01)
                 for c in ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")}
        rows.append({
            "PassengerId": f"{i // 2:04d}_{i % 2 + 1:02d}",
            "HomePlanet": None if i % 17 == 0 else rnd.choice(["Earth", "Mars", "Europa"]),
            "CryoSleep": None if i % 19 == 0 else asleep, "VIP": i % 23 == 0,
            "Cabin": None if i % 13 == 0 else f"{rnd.choice('ABFG')}/{rnd.randint(0, 1800)}/"
                                              f"{rnd.choice('PS')}",
            "Destination": rnd.choice(["X", "Y"]),
            "Age": None if i % 11 == 0 else float(rnd.randint(0, 79)),
            "Name": None if i % 29 == 0 else f"N{i} Sur{i % 30}",
            "Transported": asleep != (rnd.random() < 0.1), **spend,
        })
    return frame(spark, schemas.MANIFEST_B, rows).withColumn(
        "label", F.col("Transported").cast("double"))


@pytest.mark.parametrize("version", [1, 2])
def test_manifest_b(manifest_b, version):
    model = recipes.manifest_b(version, effort=QUICK).fit(manifest_b)
    out = ensemble.predict(model, manifest_b.drop("label"), "PassengerId", "Transported", "boolean")
    assert out.where("Transported IS NULL").count() == 0 and out.count() == 200
    truth = manifest_b.select("PassengerId", F.col("Transported").alias("truth"))
    hits = out.join(truth, "PassengerId").agg(F.avg((F.col("Transported") == F.col("truth"))
                                                    .cast("int"))).first()[0]
    assert hits > 0.75


@pytest.fixture(scope="module")
def house_rows(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        area, quality, built = rnd.uniform(60, 300) * 10, rnd.randint(1, 10), rnd.randint(1900, 2009)
        rows.append({
            "Id": i, "SalePrice": 100 * area * (1 + quality / 5) * rnd.uniform(0.9, 1.1),
            "LotArea": rnd.expovariate(1e-4), "GrLivArea": area, "TotalBsmtSF": area / 2,
            "1stFlrSF": area / 2, "2ndFlrSF": None if i % 9 == 0 else area / 2,
            "GarageArea": rnd.uniform(0, 500), "OverallQual": quality, "YearBuilt": built,
            "YearRemodAdd": built, "FullBath": 2, "HalfBath": i % 2, "BsmtFullBath": 1,
            "BsmtHalfBath": 0, "ExterQual": rnd.choice(["Ex", "Gd", "TA"]),
            "PoolQC": None, "Neighborhood": rnd.choice(["a", "b", "c"]),
            "LotFrontage": None if i % 5 == 0 else rnd.uniform(20, 100),
        })
    rows.append(dict(rows[0], Id=500, GrLivArea=5000.0, SalePrice=1.0))
    columns = ["Id", *{c: None for row in rows for c in row if c != "Id"}]
    return frame(spark, schemas.HOUSES, rows).select(*columns).withColumnRenamed(
        "SalePrice", "label")


@pytest.mark.parametrize("version", [1, 2])
def test_houses(house_rows, version):
    cleaned = recipes.clean_houses(house_rows, version)
    assert cleaned.count() == (121 if version == 1 else 120)
    rows = house_rows.where("Id < 500")
    scored = recipes.houses(version, effort=0.002, folds=2).fit(
        recipes.clean_houses(rows, version)).transform(rows.drop("label"))
    both = scored.select("Id", "prediction").join(rows.select("Id", "label"), "Id")
    logs = both.select("Id", F.log1p("prediction").alias("prediction"),
                       F.log1p("label").alias("label"))
    spread = logs.agg(F.stddev_pop("label")).first()[0]
    assert scored.count() == 120
    assert logs.agg(stats.rmse()).first()[0] < 0.6 * spread


def test_splits_come_back_whole(manifest_a):
    train = manifest_a.where("PassengerId < 100")
    test = manifest_a.where("PassengerId >= 100").drop("Survived", "label")
    stacked = stack_splits(train=train, test=test)
    assert by_split(stacked, "train").count() == 100
    assert by_split(stacked, "test").where("Survived IS NULL").count() == 60
