"""Profiles and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.catalog.registry import query
from tabforge.operators import stats
from tabforge.operators.columns import gap
from tabforge.operators.quantiles import medians
from tabforge.sources.tables import load

GAPPED_SQL = """
gapped AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity
  FROM lineitem)
"""


def gapped_lineitem(spark, sf_dir):
    """lineitem with every seventh order's quantity missing."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus",
        gap(F.col("l_orderkey") % 7 == 0, F.col("l_quantity")).alias("l_quantity"),
    )


_DTYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_quantity": "double",
}


@query(
    "null_profile",
    f"WITH {GAPPED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS n_rows, "
        f"count({c}) AS n_present, count(*) - count({c}) AS n_missing FROM gapped"
        for c, kind in _DTYPES.items()
    ),
)
def null_profile(spark, sf_dir):
    return stats.profile(gapped_lineitem(spark, sf_dir))


@query(
    "missing_counts",
    f"WITH {GAPPED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM gapped"
        for c in _DTYPES
    ),
)
def missing_counts(spark, sf_dir):
    return stats.null_counts(gapped_lineitem(spark, sf_dir))


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "describe_numeric",
    f"WITH {GAPPED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 7) AS mean,
        round(stddev_samp({c}), 7) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM gapped"""
        for c in _DESCRIBED
    ),
)
def describe_numeric(spark, sf_dir):
    found = stats.describe(gapped_lineitem(spark, sf_dir), _DESCRIBED)
    return _rounded(_rounded(found, ["mean", "std"], 7), ["q25", "q50", "q75"])


@query(
    "column_medians",
    f"""WITH {GAPPED_SQL}
    SELECT round(median(l_quantity), 6) AS l_quantity,
           round(median(l_extendedprice), 6) AS l_extendedprice,
           round(median(l_discount), 6) AS l_discount FROM gapped""",
)
def column_medians(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return _rounded(medians(gapped_lineitem(spark, sf_dir), cols), cols)


@query(
    "column_modes",
    """SELECT (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_type,
              (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_size,
              (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_name""",
)
def column_modes(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    found = [stats.grouped_mode(part, [], c) for c in ("p_type", "p_size", "p_name")]
    return found[0].crossJoin(found[1]).crossJoin(found[2])  # three one-row results side by side


@query(
    "column_bounds",
    f"""WITH {GAPPED_SQL}
    SELECT min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max
    FROM gapped""",
)
def column_bounds(spark, sf_dir):
    return stats.bounds(gapped_lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"])


@query(
    "value_counts",
    "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY n DESC",
)
def value_counts(spark, sf_dir):
    return stats.value_counts(load(spark, sf_dir, "part"), "p_name").orderBy(F.desc("n"))


_SKEW_COLS = ["value", "root_value", "log_value"]
_SKEW_SQL = """events3 AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
         sqrt(value) AS root_value, ln(1 + value) AS log_value FROM events)"""


def _skew_frame(spark, sf_dir):
    value = F.col("value")
    return load(spark, sf_dir, "events").select(
        gap(F.col("event_id") % 11 == 0, value).alias("value"),
        F.sqrt(value).alias("root_value"),
        F.log1p(value).alias("log_value"),
    )


@query(
    "skewed_columns_population",
    f"""WITH {_SKEW_SQL}, mid AS (
      SELECT median(value) AS v, median(root_value) AS r, median(log_value) AS l FROM events3),
    filled AS (
      SELECT coalesce(value, v) AS value, coalesce(root_value, r) AS root_value,
             coalesce(log_value, l) AS log_value FROM events3, mid),
    found AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
        round(abs(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))), 6)
        AS skew FROM filled"""
        for c in _SKEW_COLS
    )
    + ") SELECT * FROM found WHERE skew > 0.75 ORDER BY skew DESC",
)
def skewed_columns_population(spark, sf_dir):
    found = stats.skewed_columns(_skew_frame(spark, sf_dir), _SKEW_COLS, bias=True)
    return _rounded(found, ["skew"])


@query(
    "skewed_columns_adjusted",
    f"WITH {_SKEW_SQL}, found AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skew FROM events3"
        for c in _SKEW_COLS
    )
    + ") SELECT * FROM found WHERE skew > 0.75 ORDER BY skew DESC",
)
def skewed_columns_adjusted(spark, sf_dir):
    found = stats.skewed_columns(_skew_frame(spark, sf_dir), _SKEW_COLS, bias=False)
    return _rounded(found, ["skew"])


@query(
    "contingency",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def contingency(spark, sf_dir):
    return stats.contingency(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "class_histogram",
    """WITH joined AS (
      SELECT quality, n_chars::DOUBLE AS n FROM documents JOIN labels USING (doc_id)),
    binned AS (
      SELECT quality, CASE WHEN n < 0 THEN 0 WHEN n >= 20000 THEN 21
                           ELSE floor(n * 20 / 20000)::INT + 1 END AS bin FROM joined)
    SELECT quality, bin::BIGINT AS bin, count(*) AS n,
           round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 9) AS share
    FROM binned GROUP BY quality, bin""",
)
def class_histogram(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    found = stats.class_histogram(joined, "quality", "n_chars", 20, 0.0, 20000.0)
    return _rounded(found, ["share"], 9)


@query(
    "coverage",
    """SELECT count(*) FILTER (o_totalprice > 250000) AS n_kept, count(*) AS n_rows,
       round(count(*) FILTER (o_totalprice > 250000) / count(*) * 100, 6) AS pct_kept
       FROM orders""",
)
def coverage(spark, sf_dir):
    found = stats.coverage(load(spark, sf_dir, "orders"), F.col("o_totalprice") > 250000)
    return _rounded(found, ["pct_kept"])
