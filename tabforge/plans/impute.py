"""Imputers that learn on the fitted rows and fill any other rows."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.text import parse_group
from tabforge.operators.lookup import fill_from_group_mode, lookup_fitted
from tabforge.operators.neighbors import knn_join
from tabforge.operators.quantiles import fitted_quantiles, medians
from tabforge.operators.stats import modes
from tabforge.plans.base import Configured, TableModel, setting
from tabforge.session import settle


class MedianImputer(Configured, Estimator):
    """Fill with the exact median."""

    cols = setting("cols", "columns to fill")

    def _fit(self, df: DataFrame) -> "FillModel":
        found = fitted_quantiles(df, self.get("cols"), [0.5])
        return FillModel(fills={c: v[0] for c, v in found.items() if v})


class ModeImputer(Configured, Estimator):
    """Fill with the most frequent value, the smallest of tied ones; any type."""

    cols = setting("cols", "columns to fill")

    def _fit(self, df: DataFrame) -> "FillModel":
        found = modes(df, self.get("cols"))
        return FillModel(fills={c: v for c, v in found.items() if v is not None})


class FillModel(Configured, Model):
    fills = setting("fills", "value per column; a column without any value has none")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in self.get("fills").items()})


class _GroupMedianSettings(Configured):
    keys = setting("keys", "group columns")
    col = setting("col", "column to fill")
    default = setting("default", "fill of a group the fit has not seen; NULL if not given")
    defaults = {"default": None}


class GroupMedianImputer(_GroupMedianSettings, Estimator):
    """Fill with the fitted median of the row's group."""

    def _fit(self, df: DataFrame) -> "GroupMedianModel":
        found = medians(df, [self.get("col")], self.get("keys"))
        return GroupMedianModel(
            tables={"medians": found.withColumnRenamed(self.get("col"), "_typical")},
            **{name: self.get(name) for name in ("keys", "col", "default")},
        )


class GroupMedianModel(_GroupMedianSettings, TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        columns, col = df.columns, self.get("col")
        out = lookup_fitted(df, self.tables["medians"], self.get("keys"))
        typical = F.coalesce("_typical", F.lit(self.get("default")).cast("double"))
        return out.withColumn(col, F.coalesce(F.col(col), typical)).select(*columns)


class GroupModeFill(Configured, Transformer):
    """Fill from the most frequent value of the travel group, within the batch."""

    id_col = setting("id_col", "group_member id column")
    col = setting("col", "column to fill")

    def _transform(self, df: DataFrame) -> DataFrame:
        grouped = df.withColumn("_group", parse_group(F.col(self.get("id_col")))["group"])
        return fill_from_group_mode(grouped, "_group", self.get("col")).drop("_group")


class _KnnSettings(Configured):
    cols = setting("cols", "numeric columns, both distance features and columns to fill")
    id_col = setting("id_col", "row key")
    k = setting("k", "neighbours per gap")
    defaults = {"k": 5}


class KnnImputer(_KnnSettings, Estimator):
    """Fill with the mean of the k nearest fitted rows that have the value.

    The distance uses the features both rows have, scaled up to all features.
    A gap without any comparable donor takes the column mean.
    """

    def _fit(self, df: DataFrame) -> "KnnImputerModel":
        cols = self.get("cols")
        means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
        return KnnImputerModel(
            tables={"donors": df.select(self.get("id_col"), *cols)},
            means={c: m for c, m in means.items() if m is not None},
            cols=cols, id_col=self.get("id_col"), k=self.get("k"),
        )


class KnnImputerModel(_KnnSettings, TableModel):
    means = setting("means", "mean per column")

    def _with_pattern(self, df: DataFrame) -> DataFrame:
        """Add the presence pattern ('1011': third feature missing) and the feature array."""
        cols = self.get("cols")
        present = [F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols]
        vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
        return df.withColumn("pattern", F.concat(*present)).withColumn("vec", vec)

    def _spaces(self, receivers: DataFrame, donors: DataFrame) -> tuple[list, list]:
        """Which receiver pattern looks at which donor pattern, and by which shared features.

        A space holds the donors of one pattern by one mask of shared features: whoever
        shares the same features with them looks there, for all gaps at once. There are
        at most 2**features patterns of each kind, whatever the row count.
        """
        cols = self.get("cols")
        seeking = [row[0] for row in receivers.select("pattern").distinct().collect()]
        giving = [row[0] for row in donors.select("pattern").distinct().collect()]
        seek, give = set(), set()
        for mine in seeking:
            for theirs in giving:
                mask = "".join("1" if a == b == "1" else "0" for a, b in zip(mine, theirs))
                useful = any(a == "0" and b == "1" for a, b in zip(mine, theirs))
                if useful and "1" in mask:
                    space = f"{theirs}|{mask}"
                    seek.add((mine, space, len(cols) / mask.count("1"), mask))
                    give.add((theirs, space, mask))
        return sorted(seek), sorted(give)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, key = self.get("cols"), self.get("id_col")
        receivers = self._with_pattern(df.select(F.col(key).alias("rid"), *cols)).where(
            F.col("pattern").contains("0")
        )
        donors = self._with_pattern(
            self.tables["donors"].select(F.col(key).alias("did"), *cols)
        )
        seek, give = self._spaces(receivers, donors)
        means = self.get("means")
        if not seek:
            return df.withColumns(
                {c: F.coalesce(F.col(c).cast("double"), F.lit(means.get(c))) for c in cols}
            )
        spark = df.sparkSession
        seek = spark.createDataFrame(seek, "pattern string, space string, scale double, mask string")
        give = spark.createDataFrame(give, "pattern string, space string, mask string")
        masked = F.transform(
            "vec", lambda x, i: F.when(F.substr("mask", i + 1, F.lit(1)) == "1", x).otherwise(0.0)
        )
        # A target begins with the pattern of its receiver, which says where its gaps are.
        # The k nearest of each space serve every gap; what is nearest over all spaces
        # that have a gap's value is among them.
        near = knn_join(
            receivers.join(seek, "pattern").select(
                "rid", F.concat_ws("|", "pattern", "space").alias("target"), "space", "scale", masked.alias("vec")
            ),
            donors.join(give, "pattern").select(
                "did", "space", masked.alias("vec"), F.array(*[F.col(c).cast("double") for c in cols]).alias("payload")
            ),
            self.get("k"),
        )
        gaps = near.select("rid", "did", "distance2", "target", F.posexplode("payload").alias("at", "value")).where(
            "value IS NOT NULL AND substr(target, at + 1, 1) = '0'"
        )
        order = Window.partitionBy("rid", "at").orderBy("distance2", "did")
        found = gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.get("k"))
        filled = settle(  # stages that follow read it again and again
            found.groupBy(F.col("rid").alias(key)).agg(
                *[F.avg(F.when(F.col("at") == k, F.col("value"))).alias(f"_fill_{c}") for k, c in enumerate(cols)]
            )
        )
        out = df.join(filled, key, "left").withColumns(
            {
                c: F.coalesce(F.col(c).cast("double"), f"_fill_{c}", F.lit(means.get(c)))
                for c in cols
            }
        )
        return out.drop(*[f"_fill_{c}" for c in cols])
