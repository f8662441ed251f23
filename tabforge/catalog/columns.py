"""Projections, filters, column functions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.catalog.registry import query
from tabforge.functions import mapping, numeric as num, text
from tabforge.operators import columns as col_ops
from tabforge.operators.circles import circle_intersections
from tabforge.operators.columns import gap
from tabforge.operators.order import running_total
from tabforge.sources.tables import load


@query(
    "project_flags",
    """SELECT c_custkey, c_nationkey,
         CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_acctbal = 0 THEN 1 ELSE 0 END AS is_zero,
         CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS is_rich,
         CAST(round(c_acctbal, 0) AS BIGINT) AS rounded,
         'customer' AS origin, c_nationkey AS label
       FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def project_flags(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    balance = F.col("c_acctbal")
    flagged = customer.withColumns(
        {
            "is_zero": num.flag(balance == 0),
            "is_rich": num.flag(balance > 5000),
            "rounded": F.round(balance, 0).cast("bigint"),
            "c_acctbal": num.clip_lower(balance, F.lit(0.0)),
            "origin": F.lit("customer"),
        }
    )
    kept = col_ops.drop_cols(flagged, ["c_name", "no_such_column"], tolerant=True)
    features = col_ops.present_or_first(kept, ["c_acctbal", "is_zero", "is_rich", "absent"])
    return col_ops.split_xy(
        kept, "c_nationkey", ["c_custkey", "c_nationkey", "rounded", "origin", *features]
    )


@query(
    "numeric_projection",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def numeric_projection(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return col_ops.select_features(orders, col_ops.numeric_columns(orders))


@query(
    "first_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def first_rows(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "filter_outliers",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 450000",
)
def filter_outliers(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return col_ops.filter_below(orders, "o_totalprice", 450000)


@query(
    "exclude_ids",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_orderkey NOT IN (1299, 524)
         AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def exclude_ids(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    in_debt = load(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    kept = col_ops.exclude_ids(orders, "o_orderkey", [1299, 524])
    return col_ops.exclude_ids(kept, "o_custkey", in_debt).select("o_orderkey", "o_custkey")


@query(
    "conditional_update",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS charged
       FROM lineitem""",
)
def conditional_update(spark, sf_dir):
    returned = F.col("l_returnflag") == "R"
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        num.set_where(F.col("l_extendedprice"), returned, 0.0).alias("charged"),
    )


@query(
    "map_ordinal",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4
         WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END AS urgency,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 8 END AS status_code
       FROM orders""",
)
def map_ordinal(spark, sf_dir):
    urgency = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        mapping.map_values(F.col("o_orderpriority"), urgency).alias("urgency"),
        mapping.map_values(F.col("o_orderstatus"), {"F": 1, "O": 2}, 8).alias("status_code"),
    )


@query(
    "replace_rare",
    """SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'RARE' ELSE p_type END
         AS p_type, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 1 ELSE 0 END AS is_rare
       FROM part""",
)
def replace_rare(spark, sf_dir):
    merged = mapping.replace_values(F.col("p_type"), {"PROMO": "RARE", "SMALL": "RARE"})
    return load(spark, sf_dir, "part").select(
        "p_partkey", merged.alias("p_type"), num.flag(merged == "RARE").alias("is_rare")
    )


_TITLE_SQL = r"regexp_extract(text, ' ([A-Za-z]+)\.', 1)"


@query(
    "title_extract",
    f"""SELECT doc_id, {_TITLE_SQL} AS title, nullif({_TITLE_SQL}, '') AS title_or_null
        FROM documents""",
)
def title_extract(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        text.extract_title(F.col("text")).alias("title"),
        text.extract_title(F.col("text"), empty_as_null=True).alias("title_or_null"),
    )


@query(
    "parse_composite",
    """WITH cabins AS (
      SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL
               ELSE upper(substr(p_name, 1, 1)) || '/' || p_size || '/' || substr(p_type, 1, 1)
             END AS cabin, p_type FROM part)
    SELECT p_partkey, coalesce(substr(cabin, 1, 1), 'M') AS letter,
           split_part(coalesce(cabin, 'T/0/P'), '/', 1) AS deck,
           split_part(coalesce(cabin, 'T/0/P'), '/', 2)::DOUBLE AS num,
           split_part(coalesce(cabin, 'T/0/P'), '/', 3) AS side,
           split_part(coalesce(cabin, 'T/0/P'), '/', 1)
             || split_part(coalesce(cabin, 'T/0/P'), '/', 3) AS deck_side
    FROM cabins""",
)
def parse_composite(spark, sf_dir):
    composed = F.concat_ws(
        "/", F.upper(F.substring("p_name", 1, 1)), "p_size", F.substring("p_type", 1, 1)
    )
    cabins = load(spark, sf_dir, "part").select(
        "p_partkey", gap(F.col("p_partkey") % 5 == 0, composed).alias("cabin")
    )
    parsed = cabins.withColumn("parts", text.parse_cabin(F.col("cabin")))
    return parsed.select(
        "p_partkey",
        text.deck_letter(F.col("cabin")).alias("letter"),
        "parts.deck", "parts.num", "parts.side",
        text.concat_cols(F.col("parts.deck"), F.col("parts.side")).alias("deck_side"),
    )


@query(
    "url_parts",
    """SELECT page_id, split_part(url, '/', 1) AS deck, try_cast(split_part(url, '/', 2) AS DOUBLE)
         AS num, split_part(url, '/', 3) AS side FROM pages""",
)
def url_parts(spark, sf_dir):
    parts = text.parse_cabin(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", parts.alias("p")).select(
        "page_id", "p.*"
    )


@query(
    "bin_right",
    """SELECT p_partkey,
      CASE WHEN p_size <= 16 THEN 0 WHEN p_size <= 26 THEN 1 WHEN p_size <= 36 THEN 2
           WHEN p_size <= 62 THEN 3 ELSE 4 END AS size_bin FROM part""",
)
def bin_right(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey", num.bin_right(F.col("p_size"), num.AGE_EDGES).alias("size_bin")
    )


@query(
    "cut_regions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_extendedprice > -1 AND l_extendedprice <= 300 THEN 0
           WHEN l_extendedprice > 300 AND l_extendedprice <= 600 THEN 1
           WHEN l_extendedprice > 600 AND l_extendedprice <= 1000 THEN 2
           WHEN l_extendedprice > 1000 AND l_extendedprice <= 1500 THEN 3
           WHEN l_extendedprice > 1500 AND l_extendedprice <= 2500 THEN 4
           ELSE 0 END AS region FROM lineitem""",
)
def cut_regions(spark, sf_dir):
    region = num.bin_right(F.col("l_extendedprice"), num.REGION_EDGES, open_ends=False, other=0)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", region.alias("region")
    )


@query(
    "log_roundtrip",
    """SELECT o_orderkey, round(CASE WHEN o_totalprice - 100000 > 0
         THEN ln(o_totalprice - 100000) ELSE 0 END, 6) AS log_pos,
         round(ln(1 + o_totalprice), 6) AS log_price,
         round(exp(ln(1 + o_totalprice)) - 1, 4) AS price
       FROM orders""",
)
def log_roundtrip(spark, sf_dir):
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(num.log_pos(price - 100000), 6).alias("log_pos"),
        F.round(F.log1p(price), 6).alias("log_price"),
        F.round(num.invert_log_target(F.log1p(price)), 4).alias("price"),
    )


@query(
    "interactions",
    """WITH g AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q
                  FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         round(q * l_extendedprice, 4) AS quantity_price,
         round(l_tax + 0.5 * q, 6) AS half_sum,
         round(coalesce(q, 0) + l_tax, 6) AS row_sum,
         round(l_tax / (q + 1), 6) AS ratio,
         2010 - year(l_shipdate) AS age
       FROM g""",
)
def interactions(spark, sf_dir):
    quantity, tax = F.col("q"), F.col("l_tax")
    items = load(spark, sf_dir, "lineitem").withColumn(
        "q", gap(F.col("l_orderkey") % 7 == 0, F.col("l_quantity"))
    )
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(quantity * F.col("l_extendedprice"), 4).alias("quantity_price"),
        F.round(num.lin_comb([tax, quantity], [1, 0.5]), 6).alias("half_sum"),
        F.round(num.row_sum([quantity, tax]), 6).alias("row_sum"),
        F.round(num.safe_ratio(tax, quantity), 6).alias("ratio"),
        num.years_since(F.year("l_shipdate")).cast("bigint").alias("age"),
    )


@query(
    "stack_splits",
    """WITH s AS (
      SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'train' AS split
      FROM customer
      UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'test' FROM supplier)
    SELECT split, count(*) AS n_rows, count(segment) AS n_segments, round(sum(balance), 2) AS total
    FROM s GROUP BY split""",
)
def stack_splits(spark, sf_dir):
    stacked = col_ops.stack_splits(
        train=load(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
        ),
        test=load(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")
        ),
    )
    return stacked.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count("segment").alias("n_segments"),
        F.round(F.sum("balance"), 2).alias("total"),
    )


@query(
    "running_total",
    """WITH days AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
    SELECT day, n, (coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) + 1)::BIGINT AS b FROM days""",
)
def running_total_by_day(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.lit(1).alias("n")
    )
    total = running_total(orders, "day", "n")
    return total.select("day", "n", (F.col("total_before") + 1).alias("b"))


@query(
    "running_sequence",
    """SELECT o_orderkey, (1 + o_orderkey * (o_orderkey - 1) / 2)::BIGINT AS b FROM orders""",
)
def running_sequence(spark, sf_dir):
    """The recurrence b(n+1) = b(n) + n over the order keys; the SQL is its closed form."""
    keys = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_orderkey").alias("n")
    )
    total = running_total(keys, "o_orderkey", "n")
    return total.select("o_orderkey", (F.col("total_before") + 1).alias("b"))


_CIRCLES_SQL = """SELECT p_partkey AS id, p_retailprice AS x, (p_size * 37 % 50)::DOUBLE AS y,
  p_size / 4.0 AS r FROM part"""


@query(
    "circle_pairs",
    f"""WITH c AS ({_CIRCLES_SQL}),
    pairs AS (
      SELECT a.id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d,
             (a.r+b.r)*(a.r+b.r) AS outside, (a.r-b.r)*(a.r-b.r) AS inside
      FROM c a JOIN c b ON a.id <> b.id AND abs(a.x-b.x) <= a.r+b.r AND abs(a.y-b.y) <= a.r+b.r
      WHERE NOT (a.x = b.x AND a.y = b.y AND a.r = b.r))
    SELECT c.id, count(*) FILTER (d = outside OR d = inside) AS n_touch,
           count(*) FILTER (d < outside AND d > inside) AS n_cross
    FROM c LEFT JOIN pairs ON pairs.id = c.id GROUP BY c.id""",
)
def circle_pairs(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("x"),
        (F.col("p_size") * 37 % 50).cast("double").alias("y"),
        (F.col("p_size") / 4.0).alias("r"),
    )
    return circle_intersections(part)


_DIGITS = r"regexp_extract(text, '([a-z]+)', 1)"


@query(
    "clamp_answer",
    f"""SELECT item_id, greatest(0, least(99999,
          coalesce(try_cast(length(text) * 1000 - 50000 AS BIGINT), 0))) AS answer,
        coalesce(try_cast({_DIGITS} AS BIGINT), 0) AS no_answer FROM benchmark""",
)
def clamp_answer(spark, sf_dir):
    guess = (F.length("text") * 1000 - 50000).cast("string")
    word = F.regexp_extract("text", "([a-z]+)", 1)
    return load(spark, sf_dir, "benchmark").select(
        "item_id",
        num.clamp_answer(guess).alias("answer"),
        num.clamp_answer(word).alias("no_answer"),
    )
