"""Tree ensembles as one table of nodes, scored in one step and saved with the model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.plans.base import TableModel, setting

NODES = "tree int, node int, feature int, threshold double, left int, right int, value array<double>"
_COLUMNS = [part.split()[0] for part in NODES.split(", ")]
#: Rows times trees that are walked at a time.
AT_ONCE = 1 << 20
LEAF = -1


class Forest:
    """The nodes of all trees side by side; a node without a feature is a leaf."""

    def __init__(self, nodes: pa.Table):
        order = np.lexsort([nodes.column(c).to_numpy() for c in ("node", "tree")])
        lists = nodes.column("value").combine_chunks()
        values = np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1 if len(lists) else 1)
        nodes = nodes.drop_columns(["value"]).to_pandas().iloc[order].reset_index(drop=True)
        sizes = nodes.groupby("tree")["node"].size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        first = np.repeat(self.roots, sizes)
        self.feature = nodes["feature"].to_numpy(np.int64)
        self.threshold = nodes["threshold"].to_numpy(float)
        own = np.arange(len(nodes))
        inner = self.feature != LEAF
        self.left = np.where(inner, first + nodes["left"].to_numpy(np.int64), own)
        self.right = np.where(inner, first + nodes["right"].to_numpy(np.int64), own)
        self.value = values[order]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches in each tree. A missing value goes left."""
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        place = np.arange(len(rows))[:, None]
        while (inner := self.feature[at] != LEAF).any():
            high = rows[place, np.where(inner, self.feature[at], 0)] > self.threshold[at]
            at = np.where(high, self.right[at], self.left[at])
        return at

    def totals(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values over all trees, tree by tree in order."""
        out = np.zeros((len(rows), self.value.shape[1]))
        if not len(self.roots):
            return out
        step = max(1, AT_ONCE // len(self.roots))
        for first in range(0, len(rows), step):
            found = self.value[self.leaves(rows[first : first + step])]
            out[first : first + step] = found.sum(axis=1)
        return out


def node_table(spark: SparkSession, nodes: Iterable[tuple]) -> DataFrame:
    """Rows of ``NODES`` as a table; their number is bounded by the settings of the trees."""
    frame = pd.DataFrame(list(nodes), columns=_COLUMNS)
    rows = zip(*(frame[c].tolist() for c in _COLUMNS))
    return spark.createDataFrame(list(rows), NODES)


def column_table(spark: SparkSession, trees: Sequence[list[np.ndarray]]) -> DataFrame:
    """The node table from the columns of each tree's nodes; ``value`` has a row per node."""
    if not trees:
        return node_table(spark, [])
    *plain, value = (np.concatenate(columns) for columns in zip(*trees))
    starts = np.arange(0, value.size + 1, value.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(value.ravel()))
    return spark.createDataFrame(pa.table([*(pa.array(c) for c in plain), lists], names=_COLUMNS), NODES)


def spark_nodes(tree: int, root, values: list[float] | None = None) -> Iterator[tuple]:
    """Nodes of a tree fitted by Spark, numbered from its root.

    ``values`` gives each leaf, left to right, another value than its prediction.
    """
    nodes: list[list] = []
    leaf = 0
    waiting = [(root, -1, 0)]
    while waiting:
        node, parent, side = waiting.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = number
        if node.getClass().getSimpleName().startswith("Internal"):
            split = node.split()
            nodes.append([tree, number, int(split.featureIndex()), float(split.threshold()), -1, -1, [0.0]])
            waiting += [(node.rightChild(), number, 1), (node.leftChild(), number, 0)]
        else:
            value = float(node.prediction()) if values is None else values[leaf]
            leaf += 1
            nodes.append([tree, number, LEAF, 0.0, -1, -1, [value]])
    yield from map(tuple, nodes)


class TreeModel(TableModel):
    """Scores of a table of trees.

    ``kind`` says what the sum over all trees is: a 'value' (the prediction), a 'logit'
    (of class 1) or 'votes' (shares of the classes, one sum for each).
    """

    kind = setting("kind", "'value', 'logit' or 'votes'")
    start = setting("start", "what the sum begins with")
    features = setting("features", "vector column")
    defaults = {"kind": "value", "start": 0.0, "features": "features"}

    def forest(self) -> Forest:
        if getattr(self, "_forest", None) is None:
            self._forest = Forest(self.tables["nodes"].select(*_COLUMNS).toArrow())
        return self._forest

    def totals(self) -> Column:
        """Array of the sums over all trees."""
        forest = self.forest()

        @F.pandas_udf("array<double>")
        def walk(vectors: pd.Series) -> pd.Series:
            rows = np.array(vectors.to_list(), dtype=float)
            return pd.Series(list(forest.totals(rows)))

        return walk(vector_to_array(self.get("features")))

    def _transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_total", self.totals())
        margin = F.col("_total")[0] + F.lit(float(self.get("start")))
        if self.get("kind") == "value":
            return df.withColumn("prediction", margin).drop("_total")
        if self.get("kind") == "logit":
            # The larger class first, so that no exponent overflows.
            low = F.exp(-F.abs(margin)) / (1 + F.exp(-F.abs(margin)))
            good = F.when(margin > 0, 1 - low).otherwise(low)
            df = df.withColumn("_shares", F.array(1 - good, good))
        else:
            total = F.aggregate("_total", F.lit(0.0), lambda a, b: a + b)
            df = df.withColumn("_shares", F.transform("_total", lambda v: v / total))
        place = F.array_position("_shares", F.array_max("_shares")) - 1
        return (
            df.withColumn("probability", array_to_vector("_shares"))
            .withColumn("prediction", place.cast("double"))
            .drop("_total", "_shares")
        )
