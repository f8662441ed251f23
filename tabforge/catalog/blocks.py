"""Feature blocks over event spending and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.catalog.registry import query
from tabforge.operators.columns import gap
from tabforge.plans import blocks
from tabforge.sources.tables import load

_SPEND = ["click", "error", "purchase", "signup", "view"]
_SETTINGS = {
    "spend_cols": _SPEND, "luxury": ["purchase", "view"], "sustenance": ["click", "error", "signup"],
}

# One row per user: spending by event type (missing for every seventh user's clicks),
# a sleep flag with gaps, and an age with gaps.
_USERS_SQL = """
users AS (
  SELECT user_id,
    CASE WHEN user_id % 7 = 0 THEN NULL
         ELSE round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 2) END AS click,
    round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 2) AS error,
    round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS purchase,
    round(coalesce(sum(value) FILTER (event_type = 'signup'), 0), 2) AS signup,
    round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 2) AS view,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 = 0 END AS asleep,
    CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 80)::DOUBLE END AS age
  FROM events GROUP BY user_id)
"""


def users(spark, sf_dir):
    user = F.col("user_id")
    sums = [
        F.round(F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))),
                           F.lit(0.0)), 2).alias(kind)
        for kind in _SPEND
    ]
    return load(spark, sf_dir, "events").groupBy("user_id").agg(*sums).withColumns(
        {
            "click": gap(user % 7 == 0, F.col("click")),
            "asleep": gap(user % 5 == 0, user % 3 == 0),
            "age": gap(user % 4 == 0, (user % 80).cast("double")),
        }
    )


def _rounded(df, keep, cols):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in cols])


_AWAKE = """CASE WHEN asleep IS NULL AND coalesce(click, 0) + error + purchase + signup + view > 0
                 THEN false ELSE asleep END"""


@query(
    "set_where_rule",
    f"""WITH {_USERS_SQL}, awake AS (
      SELECT * REPLACE (coalesce({_AWAKE}, false) AS asleep) FROM users)
    SELECT user_id, asleep, CASE WHEN asleep THEN 0 ELSE click END AS click,
           CASE WHEN asleep THEN 0 ELSE error END AS error,
           CASE WHEN asleep THEN 0 ELSE purchase END AS purchase,
           CASE WHEN asleep THEN 0 ELSE signup END AS signup,
           CASE WHEN asleep THEN 0 ELSE view END AS view
    FROM awake""",
)
def set_where_rule(spark, sf_dir):
    awake = blocks.AwakeFromSpend(spend_cols=_SPEND, flag_col="asleep")
    rule = blocks.SleepRule(spend_cols=_SPEND, flag_col="asleep")
    return rule.transform(awake.transform(users(spark, sf_dir))).drop("age")


_SPEND_OUT = [
    "total_spend", "luxury_spend", "sustenance_spend", "luxury_ratio", "sustenance_ratio",
    "spend_power", "log_click", "log_error", "log_purchase", "log_signup", "log_view",
    "log_total_spend",
    "log_luxury_spend", "log_sustenance_spend", "log_spend_power",
]


@query(
    "spend_block",
    f"""WITH {_USERS_SQL}, mid AS (SELECT median(age) AS typical FROM users),
    spent AS (
      SELECT *, coalesce(click, 0) + error + purchase + signup + view AS total_spend,
             purchase + view AS luxury_spend, click + error + signup AS sustenance_spend,
             coalesce(age, typical) AS years FROM users, mid),
    powered AS (SELECT *, total_spend / CASE WHEN years < 1 THEN 1 ELSE years END AS spend_power
                FROM spent)
    SELECT user_id, round(total_spend, 6) AS total_spend, round(luxury_spend, 6) AS luxury_spend,
      round(sustenance_spend, 6) AS sustenance_spend,
      round(luxury_spend / (total_spend + 1), 6) AS luxury_ratio,
      round(sustenance_spend / (total_spend + 1), 6) AS sustenance_ratio,
      round(spend_power, 6) AS spend_power,
      CASE WHEN total_spend = 0 THEN 1 ELSE 0 END AS zero_spend,
      CASE WHEN years < 13 THEN 1 ELSE 0 END AS is_child,
      CASE WHEN years > 60 THEN 1 ELSE 0 END AS is_senior,
      round(ln(1 + coalesce(click, 0)), 6) AS log_click, round(ln(1 + error), 6) AS log_error,
      round(ln(1 + purchase), 6) AS log_purchase, round(ln(1 + signup), 6) AS log_signup,
      round(ln(1 + view), 6) AS log_view,
      round(ln(1 + total_spend), 6) AS log_total_spend,
      round(ln(1 + luxury_spend), 6) AS log_luxury_spend,
      round(ln(1 + coalesce(sustenance_spend, 0)), 6) AS log_sustenance_spend,
      round(ln(1 + spend_power), 6) AS log_spend_power
    FROM powered""",
)
def spend_block(spark, sf_dir):
    rows = users(spark, sf_dir)
    out = blocks.SpendBlock(age_col="age", **_SETTINGS).fit(rows).transform(rows)
    return _rounded(out, ["user_id", "zero_spend", "is_child", "is_senior"], _SPEND_OUT)


@query(
    "cluster_matrix",
    f"""WITH {_USERS_SQL}, mid AS (SELECT median(age) AS typical FROM users),
    m AS (SELECT user_id, coalesce(age, typical) AS age,
      CASE WHEN coalesce(asleep, false) THEN 0 ELSE coalesce(click, 0) END AS click,
      CASE WHEN coalesce(asleep, false) THEN 0 ELSE error END AS error,
      CASE WHEN coalesce(asleep, false) THEN 0 ELSE purchase END AS purchase,
      CASE WHEN coalesce(asleep, false) THEN 0 ELSE signup END AS signup,
      CASE WHEN coalesce(asleep, false) THEN 0 ELSE view END AS view FROM users, mid)
    SELECT user_id, round(ln(1 + click), 6) AS m_click, round(ln(1 + error), 6) AS m_error,
      round(ln(1 + purchase), 6) AS m_purchase, round(ln(1 + signup), 6) AS m_signup,
      round(ln(1 + view), 6) AS m_view,
      round(ln(1 + click + error + purchase + signup + view), 6) AS m_total, age AS m_age
    FROM m""",
)
def cluster_matrix(spark, sf_dir):
    rows = users(spark, sf_dir)
    model = blocks.ClusterMatrix(spend_cols=_SPEND, flag_col="asleep", age_col="age").fit(rows)
    return _rounded(model.transform(rows), ["user_id"], model.columns())


@query(
    "social_block",
    """WITH rows AS (
      SELECT conv_id || '_' || (turn + 1) AS row_id, conv_id, turn,
        CASE WHEN conv_id % 6 = 0 THEN NULL ELSE role || ' F' || conv_id % 40 END AS name,
        CASE WHEN conv_id % 8 = 0 THEN 'T/0/P'
             ELSE upper(substr(role, 1, 1)) || '/' || conv_id * 3 || '/S' END AS cabin
      FROM conversations),
    parsed AS (SELECT *, split_part(coalesce(name, 'Unknown Unknown'), ' ', 2) AS surname,
                 split_part(cabin, '/', 1) AS deck, split_part(cabin, '/', 2)::DOUBLE AS num,
                 split_part(cabin, '/', 3) AS side FROM rows)
    SELECT row_id, deck, side, count(*) OVER (PARTITION BY conv_id) AS group_size,
      count(*) OVER (PARTITION BY surname) AS family_size,
      count(*) OVER (PARTITION BY cabin) AS occupancy,
      round((turn + 1) / count(*) OVER (PARTITION BY conv_id), 9) AS group_rank_norm,
      CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 1 ELSE 0 END AS is_solo,
      CASE WHEN num > 1500 AND num <= 2500 THEN 4 WHEN num > 1000 AND num <= 1500 THEN 3
           WHEN num > 600 AND num <= 1000 THEN 2 WHEN num > 300 AND num <= 600 THEN 1
           ELSE 0 END AS cabin_region,
      round(num / nullif(max(num) OVER (PARTITION BY deck), 0), 9) AS relative_position
    FROM parsed""",
)
def social_block(spark, sf_dir):
    conv = F.col("conv_id")
    rows = load(spark, sf_dir, "conversations").select(
        F.concat_ws("_", conv, F.col("turn") + 1).alias("row_id"),
        gap(conv % 6 == 0, F.concat(F.col("role"), F.lit(" F"), (conv % 40).cast("string")))
        .alias("name"),
        gap(conv % 8 == 0, F.concat_ws("/", F.upper(F.substring("role", 1, 1)), conv * 3,
                                       F.lit("S"))).alias("cabin"),
    )
    block = blocks.SocialBlock(id_col="row_id", name_col="name", cabin_col="cabin")
    out = block.fit(rows).transform(rows).drop("name", "cabin")
    return out.withColumns(
        {c: F.round(c, 9) for c in ("group_rank_norm", "relative_position")}
    )


@query(
    "area_block",
    """WITH g AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
                  year(l_shipdate) AS shipped, year(o_orderdate) AS ordered
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    a AS (SELECT *, coalesce(q, 0) + l_extendedprice / 100 + l_tax AS total_area FROM g)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(total_area, 6) AS total_area,
      round(q + 0.5 * l_linenumber, 6) AS total_bath, (2010 - ordered)::INT AS built_age,
      (2010 - shipped)::INT AS remodel_age,
      round(CASE WHEN l_linenumber * total_area > 3000 THEN 3000
                 ELSE l_linenumber * total_area END, 6) AS quality_area,
      round(CASE WHEN l_linenumber * q > 3000 THEN 3000 ELSE l_linenumber * q END, 6)
        AS quality_living,
      least(l_linenumber * ordered, 3000)::INT AS quality_built,
      least(l_linenumber * (2010 - ordered), 3000)::INT AS quality_age
    FROM a""",
)
def area_block(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax",
        gap(F.col("l_orderkey") % 7 == 0, F.col("l_quantity")).alias("q"),
        (F.col("l_extendedprice") / 100).alias("price"),
        F.year("l_shipdate").alias("shipped"),
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("ordered")
    )
    block = blocks.HouseBlock(
        area_cols=["q", "price", "l_tax"], bath_weights={"q": 1.0, "l_linenumber": 0.5},
        quality_col="l_linenumber", living_col="q", built_col="ordered", remodel_col="shipped",
        cap=3000,
    )
    out = block.transform(lines.join(orders, "l_orderkey"))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "built_age", "remodel_age",
            "quality_built", "quality_age"]
    return _rounded(out, keep, ["total_area", "total_bath", "quality_area", "quality_living"])


@query(
    "quality_scale",
    """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL
                  ELSE o_orderpriority END AS grade, CASE WHEN o_orderkey % 4 = 0 THEN NULL
                  ELSE o_orderstatus END AS status FROM orders)
    SELECT o_orderkey, CASE grade WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM'
           THEN 3 ELSE 0 END AS grade, coalesce(status, 'None') AS status FROM g""",
)
def quality_scale(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", gap(key % 3 == 0, F.col("o_orderpriority")).alias("grade"),
        gap(key % 4 == 0, F.col("o_orderstatus")).alias("status"),
    )
    scale = blocks.QualityScale(
        cols=["grade"], scale={"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "None": 0}
    )
    return blocks.NoneCategories(cols=["status"]).transform(scale.transform(orders))


@query(
    "deskew",
    """WITH g AS (SELECT event_id, value, sqrt(value) AS root_value FROM events),
    s AS (SELECT skewness(value) AS sv, skewness(root_value) AS sr FROM g)
    SELECT event_id, round(CASE WHEN sv > 0.75 THEN ln(1 + value) ELSE value END, 6) AS value,
           round(CASE WHEN sr > 0.75 THEN ln(1 + root_value) ELSE root_value END, 6) AS root_value
    FROM g, s""",
)
def deskew(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(
        "event_id", "value", F.sqrt("value").alias("root_value")
    )
    stage = blocks.Deskew(cols=["value", "root_value"], bias=False)
    return _rounded(stage.fit(events).transform(events), ["event_id"], ["value", "root_value"])
