"""Lookups of fitted values, group fills and group sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.catalog.registry import query
from tabforge.catalog.statistics import GAPPED_SQL, gapped_lineitem
from tabforge.functions import numeric as num
from tabforge.functions import text
from tabforge.operators import lookup
from tabforge.operators.columns import gap
from tabforge.operators.order import kfold, stratified_kfold
from tabforge.operators.quantiles import medians
from tabforge.operators.stats import grouped_max, grouped_mode, value_counts
from tabforge.sources.tables import load

_TRAIN = "p_partkey % 10 <> 0"


@query(
    "lookup_group_max",
    f"""WITH top AS (SELECT p_brand, max(p_size) AS brand_max FROM part
                     WHERE {_TRAIN} AND p_brand <> 'Brand#7' GROUP BY 1)
    SELECT p_partkey, p_size, coalesce(brand_max, 2000) AS brand_max
    FROM part LEFT JOIN top USING (p_brand)""",
)
def lookup_group_max(spark, sf_dir):
    """Maxima fitted on nine tenths of the parts, one brand unseen, looked up for all."""
    part = load(spark, sf_dir, "part")
    train = part.where(_TRAIN).where("p_brand <> 'Brand#7'")
    top = grouped_max(train, ["p_brand"], "p_size").withColumnRenamed("p_size", "brand_max")
    found = lookup.lookup_fitted(part, top, ["p_brand"], {"brand_max": 2000})
    return found.select("p_partkey", "p_size", "brand_max")


@query(
    "relative_position",
    f"""WITH top AS (SELECT p_brand, max(p_size) AS brand_max FROM part
                     WHERE {_TRAIN} AND p_brand <> 'Brand#7' GROUP BY 1)
    SELECT p_partkey, round(p_size / coalesce(brand_max, 2000.0), 9) AS position
    FROM part LEFT JOIN top USING (p_brand)""",
)
def relative_position(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    train = part.where(_TRAIN).where("p_brand <> 'Brand#7'")
    top = grouped_max(train, ["p_brand"], "p_size").withColumnRenamed("p_size", "brand_max")
    position = num.relative_position(F.col("p_size"), F.col("brand_max").cast("double"))
    found = lookup.lookup_fitted(part, top, ["p_brand"])
    return found.select("p_partkey", F.round(position, 9).alias("position"))


@query(
    "lookup_two_keys",
    f"""WITH {GAPPED_SQL}, mid AS (
      SELECT l_returnflag, l_linestatus, median(l_quantity) AS typical FROM gapped
      WHERE l_returnflag <> 'N' GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(coalesce(l_quantity, typical, 28), 6) AS quantity
    FROM gapped LEFT JOIN mid USING (l_returnflag, l_linestatus)""",
)
def lookup_two_keys(spark, sf_dir):
    items = gapped_lineitem(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    seen = items.where("l_returnflag <> 'N'")
    typical = medians(seen, ["l_quantity"], keys).withColumnRenamed("l_quantity", "typical")
    found = lookup.lookup_fitted(items, typical, keys, {"typical": 28.0})
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.coalesce("l_quantity", "typical"), 6).alias("quantity"),
    )


@query(
    "group_mode",
    """WITH counts AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT p_brand, arg_min(p_type, (-n, p_type)) AS p_type FROM counts GROUP BY 1""",
)
def group_mode(spark, sf_dir):
    return grouped_mode(load(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query(
    "fill_group_mode",
    """WITH g AS (SELECT p_partkey, p_brand,
                         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
    ranked AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand
                      ORDER BY count(*) DESC, p_type) AS place
               FROM g WHERE p_type IS NOT NULL GROUP BY 1, 2)
    SELECT p_partkey, coalesce(g.p_type, ranked.p_type) AS p_type
    FROM g LEFT JOIN ranked ON g.p_brand = ranked.p_brand AND place = 1""",
)
def fill_group_mode(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", gap(F.col("p_partkey") % 6 == 0, F.col("p_type")).alias("p_type")
    )
    return lookup.fill_from_group_mode(part, "p_brand", "p_type").select("p_partkey", "p_type")


@query(
    "group_median_fill",
    f"""WITH {GAPPED_SQL}, mid AS (
      SELECT l_returnflag, median(l_quantity) AS typical FROM gapped GROUP BY 1)
    SELECT l_returnflag, count(*) AS n_rows,
           round(avg(coalesce(l_quantity, typical)), 6) AS avg_quantity
    FROM gapped JOIN mid USING (l_returnflag) GROUP BY 1""",
)
def group_median_fill(spark, sf_dir):
    items = gapped_lineitem(spark, sf_dir).select("l_returnflag", "l_quantity")
    filled = lookup.fill_group_median(items, ["l_returnflag"], "l_quantity")
    return filled.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity")
    )


@query(
    "group_size",
    """SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS group_size,
              CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 1 ELSE 0 END AS is_solo
       FROM conversations""",
)
def group_size(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    sized = lookup.group_size(turns, "conv_id")
    return sized.withColumn("is_solo", num.flag(F.col("group_size") == 1))


@query(
    "rank_norm",
    """SELECT conv_id || '_' || (turn + 1) AS row_id, conv_id::VARCHAR AS "group",
              (turn + 1)::INT AS member,
              round((turn + 1) / count(*) OVER (PARTITION BY conv_id), 9) AS rank_norm
       FROM conversations""",
)
def rank_norm(spark, sf_dir):
    row_id = F.concat_ws("_", "conv_id", F.col("turn") + 1).alias("row_id")
    rows = load(spark, sf_dir, "conversations").select(row_id)
    parsed = rows.select("row_id", text.parse_group(F.col("row_id")).alias("p")).select(
        "row_id", "p.*"
    )
    sized = lookup.group_size(parsed, "group")
    share = F.round(F.col("member") / F.col("group_size"), 9)
    return sized.select("row_id", "group", "member", share.alias("rank_norm"))


@query(
    "family_counts",
    """WITH named AS (
      SELECT p_partkey, split_part(coalesce(name, 'Unknown Unknown'), ' ', 2) AS surname
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS name
            FROM part)),
    sizes AS (SELECT surname, count(*) AS family_size FROM named WHERE p_partkey % 10 <> 0
              GROUP BY 1)
    SELECT p_partkey, surname, coalesce(family_size, 1) AS family_size
    FROM named LEFT JOIN sizes USING (surname)""",
)
def family_counts(spark, sf_dir):
    named = load(spark, sf_dir, "part").select(
        "p_partkey",
        text.surname(gap(F.col("p_partkey") % 9 == 0, F.col("p_name"))).alias("surname"),
    )
    sizes = value_counts(named.where(_TRAIN), "surname").withColumnRenamed("n", "family_size")
    return lookup.lookup_fitted(named, sizes, ["surname"], {"family_size": 1})


_HASH_SQL = "('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT"


@query(
    "fold_assign",
    f"SELECT o_orderkey, ({_HASH_SQL.format(seed=42, key='o_orderkey')} % 5)::INT AS fold "
    "FROM orders",
)
def fold_assign(spark, sf_dir):
    return kfold(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, 42)


@query(
    "fold_stratified",
    f"""SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality
          ORDER BY {_HASH_SQL.format(seed=7, key='doc_id')}, doc_id) - 1) % 5)::INT AS fold
        FROM labels""",
)
def fold_stratified(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return stratified_kfold(labels, "doc_id", "quality", 5, 7)
