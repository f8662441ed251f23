"""Column selection, filters and row splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = "split"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str], tolerant: bool = False) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing and not tolerant:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*cols)


def present_or_first(df: DataFrame, names: Sequence[str], n: int = 5) -> list[str]:
    """The named columns that exist; if there are none, the first ``n`` numeric ones."""
    return [c for c in names if c in df.columns] or numeric_columns(df)[:n]


def filter_below(df: DataFrame, col: str, bound: float) -> DataFrame:
    """Drop rows at or over a bound; rows without a value go too."""
    return df.where(F.col(col) < bound)


def exclude_ids(df: DataFrame, col: str, ids: Sequence | DataFrame) -> DataFrame:
    """Drop rows whose key is listed; a table of keys becomes an anti join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_anti")
    return df.where(~F.col(col).isin(list(ids)) | F.col(col).isNull())


def split_xy(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Features and target stay in one frame, so they can never lose alignment."""
    return df.select(*features, F.col(label).alias("label"))


def stack_splits(**splits: DataFrame) -> DataFrame:
    """Stack named splits; a column one split lacks is NULL there."""
    frames = [df.withColumn(SPLIT, F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def by_split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(SPLIT) == name)


def for_each_split(
    transform: Callable[[DataFrame], DataFrame], **splits: DataFrame
) -> dict[str, DataFrame]:
    """The same step on every split: one pass over the stacked rows.

    A step that learns from its rows keeps splits apart by ``split`` in its keys.
    """
    done = transform(stack_splits(**splits))
    return {name: by_split(done, name) for name in splits}


def augment(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows to the training rows by column name."""
    return train.unionByName(extra.select(*train.columns))


def gap(condition: Column, col: Column) -> Column:
    """NULL where the condition holds, for building rows with missing values."""
    return F.when(~condition, col)
