"""Joins of rows to fitted per-group values.

Values are aggregated before any shuffle of rows, so one hot group costs one
row on the aggregated side. The aggregate is written and its rows are counted: few
are broadcast, so rows of a hot group never meet in one task. Many are joined
without a hint, and adaptive execution splits the hot partitions of the row side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.quantiles import medians
from tabforge.operators.stats import grouped_mode
from tabforge.session import settle

#: Groups whose values every task may hold.
FEW_GROUPS = 10_000


def _measured(stats: DataFrame) -> DataFrame:
    stats = settle(stats)
    return F.broadcast(stats) if stats.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else stats


def lookup_fitted(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], defaults: Mapping | None = None
) -> DataFrame:
    """Left join of fitted values; groups the fit has not seen get the default."""
    out = df.join(_measured(stats), list(keys), "left")
    for col, default in (defaults or {}).items():
        out = out.withColumn(col, F.coalesce(F.col(col), F.lit(default)))
    return out


def _fill(df: DataFrame, stats: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    columns = df.columns
    out = df.join(_measured(stats.withColumnRenamed(col, "_fill")), list(keys), "left")
    return out.withColumn(col, F.coalesce(F.col(col), F.col("_fill"))).select(*columns)


def fill_from_group_mode(df: DataFrame, group: str, col: str) -> DataFrame:
    """Fill gaps with the most frequent value of the own group."""
    return _fill(df, grouped_mode(df, [group], col), [group], col)


def fill_group_median(df: DataFrame, keys: Sequence[str], col: str, **options) -> DataFrame:
    """Fill gaps with the median of the own group; rows are neither lost nor added."""
    return _fill(df, medians(df, [col], keys, **options), keys, col)


def group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Size of the own group in this batch, counted before the join."""
    counts = df.groupBy(key).agg(F.count(key).alias(out))
    return df.join(counts, key, "left")
