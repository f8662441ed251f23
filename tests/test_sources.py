from pyspark.sql import functions as F

from tabforge.sources import schemas
from tabforge.sources.csv import read_table, write_predictions


def test_csv_round_trip_with_odd_line_endings(spark, tmp_path):
    lines = [
        "PassengerId,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked",
        '1,3,"Smith, Mr. John",male,34.5,0,0,A1,7.8292,,Q',
        '2,1,"Brown, Mrs. ""Ann"" N",female,,1,0,B2,7,C5,S',
    ]
    path = tmp_path / "manifest.csv"
    path.write_bytes("\r\r\n".join(lines).encode() + b"\r\r\n")
    rows = read_table(spark, str(path), schemas.MANIFEST_A).orderBy("PassengerId").collect()
    assert [r["Name"] for r in rows] == ["Smith, Mr. John", 'Brown, Mrs. "Ann" N']
    assert rows[0]["Cabin"] is None and rows[1]["Age"] is None
    assert rows[0]["Survived"] is None and rows[1]["Embarked"] == "S"


def test_nan_and_na_become_null(spark, tmp_path):
    path = tmp_path / "houses.csv"
    path.write_text("Id,PoolQC,LotArea\n1,NA,NaN\n2,Ex,5.0\n")
    rows = read_table(spark, str(path), schemas.HOUSES, null_value="NA").orderBy("Id").collect()
    assert (rows[0]["PoolQC"], rows[0]["LotArea"]) == (None, None)
    assert (rows[1]["PoolQC"], rows[1]["LotArea"]) == ("Ex", 5.0)


def test_predictions_write_booleans_as_words(spark, tmp_path):
    df = spark.range(2).select(F.col("id"), (F.col("id") == 1).alias("Transported"))
    write_predictions(df, str(tmp_path / "out"), "id", "Transported")
    back = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("0", "False"), ("1", "True")]

