"""Ordered target statistics: a category becomes the mean label of earlier rows of it."""

from __future__ import annotations

from math import ceil

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.order import ROWS_PER_PART, hash32, running_sum
from tabforge.plans.base import Configured, TableModel, setting
from tabforge.session import settle


class _TargetSettings(Configured):
    cols = setting("cols", "category columns")
    weight = setting("weight", "rows that the prior counts for")
    suffix = setting("suffix", "ending of the encoded columns")
    defaults = {"weight": 1.0, "suffix": "_target"}

    def encoded(self) -> list[str]:
        return [f"{c}{self.get('suffix')}" for c in self.get("cols")]


class OrderedTargets(_TargetSettings, Estimator):
    """Category -> (sum of labels + weight * prior) / (rows + weight).

    The prior is the mean label. ``training`` counts, for each labelled row, the rows of
    its category before it in an order drawn by ``seed``, so that no row sees its own
    label; the fitted model counts all of them. A missing category is one of its own, an
    unknown one gets the prior. The drawn order is cut into even parts, so a category
    that holds much of the table is not one task.
    """

    key = setting("key", "row key that decides the order")
    seed = setting("seed", "seed of the order")
    label = setting("label", "label column")
    defaults = _TargetSettings.defaults | {"seed": 42, "label": "label"}

    def prior(self, df: DataFrame) -> float:
        return df.agg(F.avg(F.col(self.get("label")).cast("double"))).first()[0] or 0.0

    def training(self, df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
        """The labelled rows with their encoded columns."""
        label, weight = F.col(self.get("label")).cast("double"), self.get("weight")
        rows = settle(df.where(F.col(self.get("label")).isNotNull()))
        prior = self.prior(rows)
        parts = max(1, ceil(rows.count() / rows_per_part))
        rows = rows.withColumn("_drawn", hash32(F.col(self.get("key")), self.get("seed")))
        part = F.floor(F.col("_drawn") * parts / 2**32)
        for col, out in zip(self.get("cols"), self.encoded()):
            order = ["_drawn", self.get("key")]
            rows = running_sum(rows, label, part, order, [col], "_sum")
            rows = running_sum(rows, F.lit(1), part, order, [col], "_rows")
            rows = rows.withColumn(out, (F.col("_sum") + weight * prior) / (F.col("_rows") + weight)).drop("_sum", "_rows")
        return rows.drop("_drawn")

    def _fit(self, df: DataFrame) -> "OrderedTargetsModel":
        label = F.col(self.get("label")).cast("double")
        rows = df.where(F.col(self.get("label")).isNotNull())
        tables = {
            f"col{k}": settle(rows.groupBy(F.col(c).alias("value")).agg(F.sum(label).alias("total"), F.count("*").alias("n")))
            for k, c in enumerate(self.get("cols"))
        }
        return OrderedTargetsModel(
            tables=tables, cols=self.get("cols"), weight=self.get("weight"), suffix=self.get("suffix"), prior=self.prior(rows)
        )


class OrderedTargetsModel(_TargetSettings, TableModel):
    prior = setting("prior", "mean label")

    def _transform(self, df: DataFrame) -> DataFrame:
        weight, prior = self.get("weight"), self.get("prior")
        for k, (col, out) in enumerate(zip(self.get("cols"), self.encoded())):
            table = self.tables[f"col{k}"].select(F.col("value").alias("_value"), F.col("total").alias("_total"), F.col("n").alias("_n"))
            known = df.join(table, F.col(col).eqNullSafe(F.col("_value")), "left")
            total, n = F.coalesce("_total", F.lit(0.0)), F.coalesce("_n", F.lit(0))
            df = known.withColumn(out, (total + weight * prior) / (n + weight)).drop("_value", "_total", "_n")
        return df
