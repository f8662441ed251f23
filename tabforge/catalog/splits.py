"""Files in and out, strict drops, splits, and pipelines by column type."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.catalog.registry import query
from tabforge.catalog.statistics import GAPPED_SQL, gapped_lineitem
from tabforge.operators import columns as col_ops
from tabforge.operators import lookup
from tabforge.plans import encode, ensemble, impute
from tabforge.plans.base import FitOnBatch
from tabforge.session import shared_folder
from tabforge.sources.csv import read_table, write_predictions
from tabforge.sources.tables import load


@query("csv_round_trip", "SELECT o_orderkey, o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    """Predictions written as CSV and read back by their schema."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_predictions(load(spark, sf_dir, "orders"), path, "o_orderkey", "o_totalprice")
    schema = T.StructType(
        [T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())]
    )
    return read_table(spark, path, schema)


@query("drop_strict", "SELECT p_partkey, p_name, p_size FROM part")
def drop_strict(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    return col_ops.drop_cols(part, ["p_brand", "p_type"])


def _parties(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"),
        col_ops.gap(F.col("c_custkey") % 6 == 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return {"customer": customers, "supplier": suppliers}


_BATCHES_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS batch, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               round(coalesce(l_quantity, (SELECT median(l_quantity) FROM gapped WHERE {part})), 6) AS l_quantity
        FROM gapped WHERE {part}"""
    for name, part in (("train", "l_orderkey % 3 > 0"), ("test", "l_orderkey % 3 = 0"))
)


@query("batch_median_impute", f"WITH {GAPPED_SQL} {_BATCHES_SQL}")
def batch_median_impute(spark, sf_dir):
    """Gaps of training and test rows filled by the median of their own split."""
    lines = gapped_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    own = FitOnBatch(impute.MedianImputer(cols=["l_quantity"]))
    batches = {"train": lines.where("l_orderkey % 3 > 0"), "test": lines.where("l_orderkey % 3 = 0")}
    filled = [own.transform(rows).withColumn("batch", F.lit(name)) for name, rows in batches.items()]
    rows = filled[0].unionByName(filled[1])
    return rows.withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "split_back",
    "SELECT s_suppkey AS key, s_nationkey AS nation, s_acctbal AS balance FROM supplier",
)
def split_back(spark, sf_dir):
    """Two tables stacked and split back by where their rows came from."""
    stacked = col_ops.stack_splits(**_parties(spark, sf_dir))
    return col_ops.by_split(stacked, "supplier").select("key", "nation", "balance")


@query(
    "each_split",
    """WITH c AS (SELECT c_custkey AS key, c_nationkey AS nation,
                         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer),
    m AS (SELECT nation, median(balance) AS typical FROM c GROUP BY 1)
    SELECT key, round(coalesce(balance, typical), 6) AS balance FROM c JOIN m USING (nation)""",
)
def each_split(spark, sf_dir):
    """Gaps filled by the median of the nation within each split, in one pass over both."""

    def fill(df):
        return lookup.fill_group_median(df, [col_ops.SPLIT, "nation"], "balance")

    done = col_ops.for_each_split(fill, **_parties(spark, sf_dir))["customer"]
    return done.select("key", F.round("balance", 6).alias("balance"))


@query(
    "typed_columns",
    """WITH c AS (SELECT c_custkey AS key, c_mktsegment AS segment,
                         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer),
    m AS (SELECT median(balance) AS typical FROM c)
    SELECT key, round(coalesce(balance, typical), 6) AS balance,
           (dense_rank() OVER (ORDER BY segment) - 1)::INT AS segment_code FROM c, m""",
)
def typed_columns(spark, sf_dir):
    """Stages by column type before one assembler; the prefix prepares without assembling."""
    rows = _parties(spark, sf_dir)["customer"]
    whole = ensemble.column_stages(
        {"number": [impute.MedianImputer(cols=["balance"])], "text": [encode.OrdinalCodes(cols=["segment"])]},
        VectorAssembler(inputCols=["balance", "segment_code"], outputCol="features"),
    )
    ready = ensemble.prefix(whole).fit(rows).transform(rows)
    return ready.select("key", F.round("balance", 6).alias("balance"), "segment_code")
