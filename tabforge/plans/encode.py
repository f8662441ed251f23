"""Category encoders. Categories are numbered in sorted order."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.order import category_codes
from tabforge.plans.base import Configured, TableModel, setting
from tabforge.session import settle

LITERAL_CATEGORIES = 1_000


def _as_text(col: str) -> Column:
    return F.col(col).cast("string").alias(col)


class OrdinalCodes(Configured, Estimator):
    """Code of each category as ``<col>_code``; categories not fitted get ``unknown``.

    The categories of all columns are found in one scan. Short vocabularies become a
    literal lookup; longer ones stay a table and are joined.
    """

    cols = setting("cols", "columns to encode")
    unknown = setting("unknown", "code of a category the fit has not seen")
    defaults = {"unknown": -1}

    def _fit(self, df: DataFrame) -> "OrdinalModel":
        cols = self.get("cols")
        each = [F.struct(F.lit(k).alias("_col"), F.col(c).cast("string").alias("_word")) for k, c in enumerate(cols)]
        words = settle(df.select(F.inline(F.array(*each))).where("_word IS NOT NULL").distinct())
        sizes = {r["_col"]: r["n"] for r in words.groupBy("_col").agg(F.count("*").alias("n")).collect()}
        few = [k for k in range(len(cols)) if sizes.get(k, 0) <= LITERAL_CATEGORIES]
        short: dict[str, list[str]] = {cols[k]: [] for k in few}
        for row in words.where(F.col("_col").isin(few)).collect():  # a short vocabulary per column
            short[cols[row["_col"]]].append(row["_word"])
        short = {c: sorted(found) for c, found in short.items()}
        tables = {
            c: category_codes(words.where(F.col("_col") == k).select(F.col("_word").alias(c)), c, f"{c}_code")
            for k, c in enumerate(cols) if c not in short
        }
        return OrdinalModel(tables=tables, categories=short, **{
            name: self.get(name) for name in ("cols", "unknown")
        })


class LabelCodes(OrdinalCodes):
    """Same codes; an unseen category is NULL, as the fit is meant to cover all."""

    defaults = {"unknown": None}


class OrdinalModel(TableModel):
    cols = setting("cols", "columns to encode")
    unknown = setting("unknown", "code of a category the fit has not seen")
    categories = setting("categories", "sorted categories of the short columns")
    defaults = {"unknown": None}

    def _transform(self, df: DataFrame) -> DataFrame:
        unknown = F.lit(self.get("unknown")).cast("int")
        for c in self.get("cols"):
            out = f"{c}_code"
            if c in self.tables:
                codes = self.tables[c].withColumnRenamed(c, "_category")
                df = df.join(codes, F.col(c).cast("string") == F.col("_category"), "left")
                df = df.drop("_category")
            else:
                words = F.array(*[F.lit(word) for word in self.get("categories")[c]])
                place = F.array_position(words.cast("array<string>"), F.col(c).cast("string"))
                df = df.withColumn(out, F.when(place > 0, place.cast("int") - 1))
            df = df.withColumn(out, F.coalesce(out, unknown))
        return df


class Dummies(Configured, Estimator):
    """One 0/1 column ``<col>_<category>`` per category, the first dropped if asked."""

    cols = setting("cols", "columns to encode")
    drop_first = setting("drop_first", "leave out the first category")
    defaults = {"drop_first": True}

    def _fit(self, df: DataFrame) -> "DummiesModel":
        first = 1 if self.get("drop_first") else 0
        categories = {}
        for c in self.get("cols"):
            seen = df.where(F.col(c).isNotNull()).select(_as_text(c)).distinct()
            words = sorted(row[0] for row in seen.collect())  # as many as columns asked for
            categories[c] = words[first:]
        return DummiesModel(categories=categories)


class DummiesModel(Configured, Model):
    categories = setting("categories", "categories that get a column, per column")

    def columns(self) -> list[str]:
        return [f"{c}_{word}" for c, words in self.get("categories").items() for word in words]

    def _transform(self, df: DataFrame) -> DataFrame:
        hits = {
            f"{c}_{word}": F.coalesce(F.col(c).cast("string") == word, F.lit(False)).cast("int")
            for c, words in self.get("categories").items()
            for word in words
        }
        return df.withColumns(hits)


def one_hot(cols: list[str]) -> Pipeline:
    """Sparse one-hot vectors ``<col>_hot``; unseen and missing categories are all zeros."""
    indexes = [f"{c}_index" for c in cols]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=cols, outputCols=indexes, stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=indexes, outputCols=[f"{c}_hot" for c in cols], dropLast=True
            ),
        ]
    )
