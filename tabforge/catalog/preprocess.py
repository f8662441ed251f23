"""Imputers, encoders, scalers, neighbours, clusters, components and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.catalog.blocks import users
from tabforge.catalog.registry import query
from tabforge.catalog.statistics import GAPPED_SQL, gapped_lineitem
from tabforge.operators.columns import gap
from tabforge.operators.order import kfold
from tabforge.plans import encode, impute, manifold, models, outlier, scale
from tabforge.plans.blocks import ClusterMatrix
from tabforge.session import settle
from tabforge.sources.tables import load

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _round(cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


@query(
    "median_impute",
    f"""WITH {GAPPED_SQL}, mid AS (SELECT median(l_quantity) AS typical FROM gapped)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(coalesce(l_quantity, typical), 6) AS l_quantity FROM gapped, mid""",
)
def median_impute(spark, sf_dir):
    items = gapped_lineitem(spark, sf_dir).select(*_KEYS, "l_quantity")
    return impute.MedianImputer(cols=["l_quantity"]).fit(items).transform(items)


@query(
    "mode_impute",
    """WITH g AS (SELECT doc_id, quality, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang
                  FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id,
      coalesce(quality, (SELECT quality FROM g WHERE quality IS NOT NULL GROUP BY 1
                         ORDER BY count(*) DESC, 1 LIMIT 1)) AS quality,
      coalesce(lang, (SELECT lang FROM g WHERE lang IS NOT NULL GROUP BY 1
                      ORDER BY count(*) DESC, 1 LIMIT 1)) AS lang
    FROM g""",
)
def mode_impute(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", gap(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang")
    )
    rows = docs.join(load(spark, sf_dir, "labels").drop("toxic"), "doc_id", "left")
    return impute.ModeImputer(cols=["quality", "lang"]).fit(rows).transform(rows)


@query(
    "const_fill",
    """SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def const_fill(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    rows = docs.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.fillna({"quality": 0, "toxic": -1})


@query(
    "label_codes",
    """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment_code
       FROM customer""",
)
def label_codes(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    model = encode.LabelCodes(cols=["c_mktsegment"]).fit(customer)
    return model.transform(customer).drop("c_mktsegment")


_SEEN = "c_mktsegment <> 'FURNITURE'"


@query(
    "ordinal_unknown",
    f"""WITH codes AS (SELECT DISTINCT c_mktsegment,
          (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code
          FROM customer WHERE {_SEEN})
    SELECT c_custkey, coalesce(code, -1) AS c_mktsegment_code
    FROM customer LEFT JOIN codes USING (c_mktsegment)""",
)
def ordinal_unknown(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    model = encode.OrdinalCodes(cols=["c_mktsegment"]).fit(customer.where(_SEEN))
    return model.transform(customer).drop("c_mktsegment")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "onehot_ignore",
    f"""WITH seen AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS words
                      FROM customer WHERE {_SEEN})
    SELECT c_custkey, CASE WHEN c_mktsegment = words[1] THEN 1::DOUBLE ELSE 0::DOUBLE END AS hot_0,
      CASE WHEN c_mktsegment = words[2] THEN 1::DOUBLE ELSE 0::DOUBLE END AS hot_1,
      CASE WHEN c_mktsegment = words[3] THEN 1::DOUBLE ELSE 0::DOUBLE END AS hot_2,
      CASE WHEN c_mktsegment = words[4] THEN 1::DOUBLE ELSE 0::DOUBLE END AS hot_3,
      len(words) AS width FROM customer, seen""",
)
def onehot_ignore(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    model = encode.one_hot(["c_mktsegment"]).fit(customer.where(_SEEN))
    hot = model.transform(customer).withColumn("hot", vector_to_array("c_mktsegment_hot"))
    return hot.select(
        "c_custkey", *[F.get("hot", F.lit(i)).alias(f"hot_{i}") for i in range(4)],
        F.size("hot").cast("bigint").alias("width"),
    )


@query(
    "dummies_drop_first",
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
        for s in _SEGMENTS[1:]
    )
    + " FROM customer",
)
def dummies_drop_first(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    model = encode.Dummies(cols=["c_mktsegment"]).fit(customer)
    return model.transform(customer).drop("c_mktsegment")


_SCALED = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "standard_scale",
    f"WITH {GAPPED_SQL}, s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM gapped) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
    + " FROM gapped, s",
)
def standard_scale(spark, sf_dir):
    items = gapped_lineitem(spark, sf_dir)
    out = scale.StdScaler(cols=_SCALED).fit(items).transform(items)
    return out.select(*_KEYS, *_round(_SCALED))


@query(
    "robust_scale",
    f"WITH {GAPPED_SQL}, s AS (SELECT "
    + ", ".join(
        f"""median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"""
        for c in _SCALED
    )
    + " FROM gapped) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
    + " FROM gapped, s",
)
def robust_scale(spark, sf_dir):
    items = gapped_lineitem(spark, sf_dir)
    out = scale.IqrScaler(cols=_SCALED).fit(items).transform(items)
    return out.select(*_KEYS, *_round(_SCALED))


@query(
    "winsorize_p99",
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
                  FROM events),
    cap AS (SELECT quantile_cont(value, 0.99) AS top FROM g)
    SELECT event_id, round(CASE WHEN value > top THEN top ELSE value END, 6) AS value
    FROM g, cap""",
)
def winsorize_p99(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(
        "event_id", gap(F.col("event_id") % 11 == 0, F.col("value")).alias("value")
    )
    out = scale.Winsorizer(cols=["value"]).fit(events).transform(events)
    return out.select("event_id", *_round(["value"]))


_TOP = 999
_SHARES = ", ".join(f"{i / _TOP!r}::DOUBLE" for i in range(_TOP + 1))


def _ratio_sql(pair, x: str) -> str:
    def polynomial(coefficients):
        text = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            text = f"({text}::DOUBLE * {x} + {c!r}::DOUBLE)"
        return text

    return f"({polynomial(pair[0])} / {polynomial(pair[1])})"


_PROBIT_SQL = f"""CASE WHEN abs(p - 0.5) <= 0.425
  THEN (p - 0.5) * {_ratio_sql(scale.AS241_CENTRE, "(0.180625 - (p - 0.5) * (p - 0.5))")}
  WHEN t <= 5 THEN sign(p - 0.5) * {_ratio_sql(scale.AS241_MIDDLE, "(t - 1.6)")}
  ELSE sign(p - 0.5) * {_ratio_sql(scale.AS241_TAIL, "(t - 5)")} END"""


@query(
    "quantile_normal",
    f"""WITH qs AS (SELECT unnest(q) AS ref, unnest(range(0, {_TOP + 1})) AS place
                    FROM (SELECT quantile_cont(value, [{_SHARES}]) AS q FROM events)),
    refs AS (SELECT ref, min(place) AS first, max(place) AS last FROM qs GROUP BY ref),
    ends AS (SELECT min(ref) AS low, max(ref) AS high FROM refs),
    located AS (
      SELECT event_id, e.value, a.ref AS lo, a.first AS lo_first, a.last AS lo_last,
             b.ref AS hi, b.first AS hi_first
      FROM events e ASOF LEFT JOIN refs a ON e.value >= a.ref
      ASOF LEFT JOIN refs b ON e.value <= b.ref),
    shares AS (
      SELECT event_id, CASE WHEN value <= low THEN 0 WHEN value >= high THEN 1
        WHEN value = lo THEN (lo_first + lo_last) / 2.0 / {_TOP}
        ELSE (lo_last + (hi_first - lo_last) * (value - lo) / (hi - lo)) / {_TOP} END AS share
      FROM located, ends),
    inside AS (SELECT event_id, greatest(1e-7, least(1 - 1e-7, share))::DOUBLE AS p FROM shares),
    tails AS (SELECT *, sqrt(-ln(least(p, 1 - p))) AS t FROM inside)
    SELECT event_id, round({_PROBIT_SQL}, 5) AS value FROM tails""",
)
def quantile_normal(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "value")
    out = scale.QuantileNormal(cols=["value"]).fit(events).transform(events)
    return out.select("event_id", *_round(["value"], 5))


_GAPPED_PARTS_SQL = """g AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END::DOUBLE AS size,
         CASE WHEN p_partkey % 15 = 5 OR p_partkey % 15 = 1 THEN NULL ELSE p_retailprice END
           AS price, length(p_name)::DOUBLE AS name_length FROM part)"""


def _nearest_sql(target: str, other: str) -> str:
    return f"""{target}_fill AS (
      SELECT id, avg(found) AS fill FROM (
        SELECT r.id, d.{target} AS found, row_number() OVER (PARTITION BY r.id ORDER BY
          (coalesce((r.{other} - d.{other}) * (r.{other} - d.{other}), 0)
           + (r.name_length - d.name_length) * (r.name_length - d.name_length))
          * CASE WHEN r.{other} IS NULL OR d.{other} IS NULL THEN 3.0 ELSE 1.5 END, d.id) AS place
        FROM g r JOIN g d ON r.{target} IS NULL AND d.{target} IS NOT NULL)
      WHERE place <= 5 GROUP BY id)"""


@query(
    "knn_impute",
    f"""WITH {_GAPPED_PARTS_SQL}, {_nearest_sql("size", "price")}, {_nearest_sql("price", "size")}
    SELECT g.id, round(coalesce(g.size, s.fill), 6) AS size,
           round(coalesce(g.price, p.fill), 6) AS price, g.name_length
    FROM g LEFT JOIN size_fill s ON g.id = s.id LEFT JOIN price_fill p ON g.id = p.id""",
)
def knn_impute(spark, sf_dir):
    key = F.col("p_partkey")
    parts = load(spark, sf_dir, "part").select(
        key.alias("id"),
        gap(key % 10 == 0, F.col("p_size").cast("double")).alias("size"),
        gap((key % 15 == 5) | (key % 15 == 1), F.col("p_retailprice")).alias("price"),
        F.length("p_name").cast("double").alias("name_length"),
    )
    stage = impute.KnnImputer(cols=["size", "price", "name_length"], id_col="id", k=5)
    out = stage.fit(parts).transform(parts)
    return out.select("id", "name_length", *_round(["size", "price"]))


_FOLD0 = "('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT % 5"


@query(
    "knn_classify",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {_FOLD0} AS fold
                   FROM embeddings),
    near AS (
      SELECT r.vec_id, d.label, row_number() OVER (PARTITION BY r.vec_id
        ORDER BY list_distance(r.v, d.v), d.vec_id) AS place
      FROM e r JOIN e d ON d.fold <> r.fold),
    votes AS (SELECT vec_id, label, count(*) AS n FROM near WHERE place <= 10 GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS place
               FROM votes)
    SELECT vec_id, label::DOUBLE AS prediction, round(n / 10, 6) AS share
    FROM ranked WHERE place = 1""",
)
def knn_classify(spark, sf_dir):
    """Label of each vector by its ten nearest in the other four of five folds."""
    rows = settle(kfold(_embedding_rows(spark, sf_dir), "vec_id", 5, 42))
    knn = models.KnnClassifier(k=10, id_col="vec_id", classes=10)
    parts = [
        knn.fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold)) for fold in range(5)
    ]
    out = reduce(DataFrame.unionByName, parts)
    share = F.array_max(vector_to_array("probability"))
    return out.select("vec_id", "prediction", F.round(share, 6).alias("share"))


def _embedding_rows(spark, sf_dir):
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", vector.alias("features"), F.col("label").cast("double").alias("label")
    )


_MATRIX = ["m_click", "m_error", "m_purchase", "m_signup", "m_view", "m_total", "m_age"]


def event_matrix(spark, sf_dir):
    rows = users(spark, sf_dir)
    stage = ClusterMatrix(
        spend_cols=["click", "error", "purchase", "signup", "view"], flag_col="asleep", age_col="age"
    )
    return stage.fit(rows).transform(rows).select("user_id", *_MATRIX)


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """Rows per cluster of users."""
    rows = event_matrix(spark, sf_dir)
    model = manifold.ClusterId(cols=_MATRIX, k=8).fit(rows)
    return model.transform(rows).groupBy("cluster_id").agg(F.count("*").alias("n_rows"))


@query(
    "kmeans_facts",
    """SELECT count(DISTINCT user_id) AS n_rows, 8::BIGINT AS clusters, 0::BIGINT AS nearer_elsewhere FROM events""",
)
def kmeans_facts(spark, sf_dir):
    """Rows that are nearer to the mean of another cluster than to that of their own: none once the runs have settled."""
    rows = event_matrix(spark, sf_dir)
    out = settle(manifold.ClusterId(cols=_MATRIX, k=8).fit(rows).transform(rows))
    means = out.groupBy("cluster_id").agg(F.array(*[F.avg(c) for c in _MATRIX]).alias("mean")).collect()  # 8 rows

    def squared(mean):
        return sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(_MATRIX, mean)), F.lit(0.0))

    far = {r["cluster_id"]: squared(r["mean"]) for r in means}
    own = F.coalesce(*[F.when(F.col("cluster_id") == k, d) for k, d in far.items()])
    return out.agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(F.least(*far.values()) < own - 1e-6).alias("nearer_elsewhere"),
    )


@query(
    "pca_facts",
    """SELECT round(var_samp(l_quantity) + var_samp(l_extendedprice / 1000) + var_samp(l_discount * 100), 4) AS total,
              0.0::DOUBLE AS mixed FROM lineitem""",
)
def pca_facts(spark, sf_dir):
    """All components together vary as much as the columns, and no two vary together."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z")
    )
    out = manifold.PcaFeatures(cols=["x", "y", "z"], k=3).fit(rows).transform(rows)
    pairs = [("pca_1", "pca_2"), ("pca_1", "pca_3"), ("pca_2", "pca_3")]
    mixed = F.round(F.greatest(*[F.abs(F.corr(a, b)) for a, b in pairs]), 6)
    total = F.round(F.var_samp("pca_1") + F.var_samp("pca_2") + F.var_samp("pca_3"), 4)
    return out.agg(total.alias("total"), (mixed + 0.0).alias("mixed"))


@query(
    "isolation_facts",
    """SELECT count(DISTINCT user_id) AS n_rows, 100::BIGINT AS trees, least(256, count(DISTINCT user_id)) AS sample,
              true AS few_flagged FROM events""",
)
def isolation_facts(spark, sf_dir):
    """Every tree has its sample, and at most two percent of all rows are called outliers."""
    rows = event_matrix(spark, sf_dir)
    detector = outlier.IsolationForest(cols=_MATRIX, id_col="user_id")
    n = rows.count()
    drawn = detector.samples(rows, n).groupBy("tree").agg(F.count_distinct("row_id").alias("n"))
    trees, sample = drawn.agg(F.count("*"), F.min("n")).first()
    return detector.fit(rows).transform(rows).agg(
        F.count("*").alias("n_rows"), F.lit(trees).cast("long").alias("trees"), F.lit(sample).cast("long").alias("sample"),
        (F.count_if("is_outlier") <= F.ceil(F.lit(0.02) * n)).alias("few_flagged"),
    )


@query(
    "pca_plane",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x,
                         l_extendedprice / 1000 AS y FROM lineitem),
    m AS (SELECT avg(x) AS mx, avg(y) AS my,
            0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS turn FROM g),
    axes AS (SELECT mx, my, cos(turn) AS c, sin(turn) AS s FROM m),
    signed AS (SELECT mx, my, c * k AS c, s * k AS s FROM (
      SELECT *, sign(CASE WHEN abs(c) >= abs(s) THEN c ELSE s END) AS k FROM axes))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((x - mx) * c + (y - my) * s, 5) AS pca_1,
           round(((x - mx) * -s + (y - my) * c)
                 * sign(CASE WHEN abs(s) >= abs(c) THEN -s ELSE c END), 5) AS pca_2
    FROM g, signed""",
)
def pca_plane(spark, sf_dir):
    """Both components of two columns, which have a closed form."""
    rows = load(spark, sf_dir, "lineitem").select(
        *_KEYS, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    out = manifold.PcaFeatures(cols=["x", "y"], k=2).fit(rows).transform(rows)
    return out.select(*_KEYS, *_round(["pca_1", "pca_2"], 5))


@query("pca_components")
def pca_components(spark, sf_dir):
    rows = event_matrix(spark, sf_dir)
    out = manifold.PcaFeatures(cols=_MATRIX, k=3).fit(rows).transform(rows)
    return out.select("user_id", *_round(["pca_1", "pca_2", "pca_3"]))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    rows = event_matrix(spark, sf_dir)
    detector = outlier.IsolationForest(cols=_MATRIX, id_col="user_id")
    out = detector.fit(rows).transform(rows)
    return out.select("user_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_outlier")
