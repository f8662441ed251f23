"""Every registered query against its SQL on the smallest tables."""

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry_points
from tabforge.catalog import ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    flagship = entry_points.entry(spark)
    assert isinstance(flagship, DataFrame) and flagship.count() > 0


def test_bagging_sample_of_keys_drawn_very_often(spark, tmp_path):
    # One in a million orders is drawn more often than the SQL counts.
    orders = spark.createDataFrame([(k,) for k in (902516, 3313484, 4518657, 1231496, 752162, 1)], "o_orderkey long")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    with connect(tmp_path / "none") as own:
        own.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        assert differences(QUERIES["bagging_sample"](spark, str(tmp_path)), own, ORACLES["bagging_sample"]) == []
