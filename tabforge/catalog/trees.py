"""Own trees and target statistics, each next to the same tree grown in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabforge.catalog.registry import query
from tabforge.plans import extratrees, histboost, models, targets
from tabforge.sources.tables import load

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_ROWS_SQL = f"""SELECT {", ".join(_KEYS)}, l_quantity AS x0, l_discount AS x1, l_tax AS x2,
                       {{label}} AS y FROM lineitem"""
_PRICE_SQL = "l_extendedprice / 1000"
_RETURNED_SQL = "(l_returnflag = 'R')::INT::DOUBLE"


def line_rows(spark, sf_dir, label):
    lines = load(spark, sf_dir, "lineitem").select(*_KEYS, *_FEATURES, label.alias("label"))
    return VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(lines)


def _price(spark, sf_dir):
    return line_rows(spark, sf_dir, F.col("l_extendedprice") / 1000)


# --- one tree in SQL ----------------------------------------------------------------------


def _base_sql(label: str, logistic: bool) -> str:
    """Rows at the root (node 1) with the gradient and the curvature of the first round."""
    g, h = ("m - y", "m * (1 - m)") if logistic else ("m - y", "1.0")
    return f"""base AS (SELECT *, (SELECT avg(y) FROM (SELECT {label} AS y FROM lineitem)) AS m
                        FROM ({_ROWS_SQL.format(label=label)})),
    r0 AS MATERIALIZED (SELECT *, 1::BIGINT AS node, {g} AS g, {h} AS h FROM base)"""


def _gains_sql(step: int, l2: float, min_rows: int) -> str:
    """Gains of all cuts of all nodes of r<step>: (node, f, v, gain)."""
    long = " UNION ALL ".join(f"SELECT node, {f} AS f, x{f}::DOUBLE AS v, g, h FROM r{step}" for f in range(len(_FEATURES)))
    return f"""b{step} AS MATERIALIZED (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL),
    p{step} AS MATERIALIZED (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
                       sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(n) OVER a AS na FROM b{step}
                WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
    g{step} AS MATERIALIZED (
      SELECT node, f, v, gl * gl / (hl + {l2}) + (ga - gl) * (ga - gl) / (ha - hl + {l2}) - ga * ga / (ha + {l2}) AS gain
      FROM p{step} WHERE nl >= {min_rows} AND na - nl >= {min_rows} AND na > nl)"""


def _moved_sql(step: int, splits: str) -> str:
    value = "CASE s.f " + " ".join(f"WHEN {f} THEN x{f}" for f in range(len(_FEATURES))) + " END"
    return f"""r{step + 1} AS MATERIALIZED (
      SELECT r.* REPLACE (CASE WHEN s.f IS NULL THEN r.node WHEN {value} > s.v THEN 2 * r.node + 1 ELSE 2 * r.node END AS node)
      FROM r{step} r LEFT JOIN {splits} s ON s.node = r.node)"""


def best_first_sql(label: str, leaves: int, l2: float, min_rows: int, logistic: bool = False) -> list[str]:
    """Always the leaf of the largest gain is split."""
    parts = [_base_sql(label, logistic)]
    for step in range(leaves - 1):
        parts += [
            _gains_sql(step, l2, min_rows),
            f"s{step} AS MATERIALIZED (SELECT * FROM g{step} WHERE gain > 0 ORDER BY gain DESC, node, f, v LIMIT 1)",
            _moved_sql(step, f"s{step}"),
        ]
    return parts


def levels_sql(label: str, depth: int, l2: float, min_rows: int) -> list[str]:
    """Every node of a level is split by its own best cut."""
    parts = [_base_sql(label, False)]
    for step in range(depth):
        parts += [
            _gains_sql(step, l2, min_rows),
            f"""s{step} AS MATERIALIZED (SELECT * FROM g{step} WHERE gain > 0
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)""",
            _moved_sql(step, f"s{step}"),
        ]
    return parts


def symmetric_sql(label: str, depth: int, l2: float) -> list[str]:
    """One cut for all nodes of a level."""
    parts = [_base_sql(label, False)]
    for step in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {f} AS f, x{f}::DOUBLE AS v, g, h FROM r{step}" for f in range(len(_FEATURES)))
        worth = f"CASE WHEN {{h}} + {l2} > 0 THEN {{g}} * {{g}} / ({{h}} + {l2}) ELSE 0 END".format
        parts += [
            f"b{step} AS MATERIALIZED (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL)",
            f"a{step} AS (SELECT node, sum(g) AS ga, sum(h) AS ha FROM r{step} GROUP BY 1)",
            f"""c{step} AS (SELECT c.f, c.v, a.node, ga, ha, coalesce(sum(b.g), 0) AS gl, coalesce(sum(b.h), 0) AS hl
                FROM (SELECT DISTINCT f, v FROM b{step} QUALIFY v < max(v) OVER (PARTITION BY f)) c CROSS JOIN a{step} a
                LEFT JOIN b{step} b ON b.node = a.node AND b.f = c.f AND b.v <= c.v GROUP BY ALL)""",
            f"""s{step} AS MATERIALIZED (SELECT node, t.f, t.v FROM a{step}, (
                SELECT f, v, sum({worth(g='gl', h='hl')} + {worth(g='(ga - gl)', h='(ha - hl)')} - {worth(g='ga', h='ha')}) AS gain
                FROM c{step} GROUP BY ALL HAVING gain > 0 ORDER BY gain DESC, f, v LIMIT 1) t)""",
            _moved_sql(step, f"s{step}"),
        ]
    return parts


def _scored_sql(parts: list[str], last: int, step: float, l2: float, score: str = "m + {}") -> str:
    value = score.format(f"{step} * value")
    return f"""WITH {", ".join(parts)},
    leaves AS (SELECT node, -sum(g) / (sum(h) + {l2}) AS value FROM r{last} GROUP BY 1)
    SELECT {", ".join(_KEYS)}, round({value}, 4) AS prediction FROM r{last} JOIN leaves USING (node)"""


def _predicted(model, rows):
    return model.transform(rows).select(*_KEYS, F.round("prediction", 4).alias("prediction"))


# --- queries ------------------------------------------------------------------------------


@query("hist_boost_tree", _scored_sql(best_first_sql(_PRICE_SQL, 6, 1.0, 20), 5, 0.5, 1.0))
def hist_boost_tree(spark, sf_dir):
    """The first tree of histogram boosting with six leaves and a penalty."""
    rows = _price(spark, sf_dir)
    model = models.hist_boost_regressor(rounds=1, step=0.5, leaves=6, l2=1.0).fit(rows)
    return _predicted(model, rows)


_SIGMOID = "1 / (1 + exp(-(ln(m / (1 - m)) + {})))"


@query("hist_boost_logit", _scored_sql(best_first_sql(_RETURNED_SQL, 5, 0.5, 20, True), 4, 0.3, 0.5, _SIGMOID).replace("AS prediction", "AS p_returned"))
def hist_boost_logit(spark, sf_dir):
    """The first tree of a boosted classifier: Newton steps on the logistic loss."""
    rows = line_rows(spark, sf_dir, (F.col("l_returnflag") == "R").cast("double"))
    model = models.hist_boost_classifier(rounds=1, step=0.3, leaves=5, l2=0.5).fit(rows)
    return model.transform(rows).select(*_KEYS, F.round(vector_to_array("probability")[1], 4).alias("p_returned"))


@query("leafwise_tree", _scored_sql(best_first_sql(_PRICE_SQL, 31, 0.0, 20), 30, 0.5, 0.0))
def leafwise_tree(spark, sf_dir):
    """The first tree of the leaf-wise preset: thirty splits, always of the leaf that gains most."""
    rows = _price(spark, sf_dir)
    return _predicted(models.boost_preset("leafwise", rounds=1, step=0.5).fit(rows), rows)


@query("second_order_tree", _scored_sql(levels_sql(_PRICE_SQL, 3, 1.0, 1), 3, 0.01, 1.0))
def second_order_tree(spark, sf_dir):
    """The first tree of the sampled preset, here on all rows and features, three levels deep."""
    rows = _price(spark, sf_dir)
    return _predicted(models.boost_preset("sampled", rounds=1, depth=3, share=1.0).fit(rows), rows)


@query("symmetric_tree", _scored_sql(symmetric_sql(_PRICE_SQL, 3, 3.0), 3, 0.5, 3.0))
def symmetric_tree(spark, sf_dir):
    """A tree that uses one split per level."""
    rows = _price(spark, sf_dir)
    model = histboost.HistBoost(shape="symmetric", rounds=1, step=0.5, depth=3, l2=3.0, min_rows=1).fit(rows)
    return _predicted(model, rows)


@query(
    "ordered_targets",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS kind, o_totalprice / 1000 AS y,
            ('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT AS drawn FROM orders),
    m AS (SELECT *, avg(y) OVER () AS prior,
            coalesce(sum(y) OVER w, 0) AS before, count(*) OVER w AS n FROM o
          WINDOW w AS (PARTITION BY kind ORDER BY drawn, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_orderkey, round((before + prior) / (n + 1), 4) AS kind_target FROM m""",
)
def ordered_targets(spark, sf_dir):
    """Mean price of earlier orders of the same priority, in a drawn order."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") / 1000).alias("label")
    )
    rows = targets.OrderedTargets(cols=["kind"], key="o_orderkey").training(orders)
    return rows.select("o_orderkey", F.round("kind_target", 4).alias("kind_target"))


@query(
    "extra_trees_facts",
    """SELECT 20::BIGINT AS trees, 0::BIGINT AS outside, count(*) AS n_rows FROM lineitem""",
)
def extra_trees_facts(spark, sf_dir):
    """Randomised trees on all lines: cuts outside of the range that their node's rows span, which there are none of."""
    rows = line_rows(spark, sf_dir, (F.col("l_returnflag") == "R").cast("double"))
    model = extratrees.ExtraTrees(trees=20, depth=5, min_rows=20, seed=3).fit(rows)
    spans = rows.select(vector_to_array("features").alias("x")).mapInArrow(_spans(model.forest()), "node long, low double, high double, n long")
    whole = spans.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = model.tables["nodes"].where("feature >= 0").select("tree", "node", "threshold")
    numbered = nodes.join(_numbered(model), ["tree", "node"]).join(whole, F.col("place") == whole["node"], "left")
    outside = F.coalesce(~((F.col("low") <= F.col("threshold")) & (F.col("threshold") < F.col("high"))), F.lit(True))
    n_rows = F.lit(rows.count()).cast("long").alias("n_rows")
    return numbered.agg(F.count_distinct("tree").alias("trees"), F.count_if(outside).alias("outside"), n_rows)


def _numbered(model):
    """(tree, node, place): where each node stands among the nodes of all trees."""
    order = Window.orderBy("tree", "node")  # a few hundred nodes
    return model.tables["nodes"].select("tree", "node", (F.row_number().over(order) - 1).alias("place"))


def _spans(forest):
    """Least and greatest value of a node's feature among the rows that reach it, per batch."""

    def spans(batches):
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=float).reshape(batch.num_rows, -1)
            low, high = np.full(len(forest.feature), np.inf), np.full(len(forest.feature), -np.inf)
            at = np.repeat(forest.roots[None, :], len(x), axis=0)
            while (inner := forest.feature[at] >= 0).any():
                own = x[np.arange(len(x))[:, None], np.where(inner, forest.feature[at], 0)]
                np.minimum.at(low, at[inner], own[inner])
                np.maximum.at(high, at[inner], own[inner])
                at = np.where(own > forest.threshold[at], forest.right[at], forest.left[at])
            seen = np.flatnonzero(np.isfinite(low))
            columns = [pa.array(seen), pa.array(low[seen]), pa.array(high[seen]), pa.array(np.full(len(seen), len(x)))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "low", "high", "n"])

    return spans
