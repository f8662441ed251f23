"""Profiles, column statistics and scores. Every function is one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.columns import numeric_columns
from tabforge.operators.quantiles import quantiles

# Fixed value: a column is skewed above this.
SKEW_THRESHOLD = 0.75


def _long(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """Turn the one row of a whole-table aggregate into one row per column."""
    return df.select(F.inline(F.array(*entries)))


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_present, n_missing) in one pass."""
    counts = df.agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    return _long(
        counts,
        [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.col("n").alias("n_rows"),
                F.col(f"c{i}").alias("n_present"),
                (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
            )
            for i, (name, dtype) in enumerate(df.dtypes)
        ],
    )


def null_counts(df: DataFrame) -> DataFrame:
    return profile(df).select("column", "n_missing")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column."""
    cols = list(cols or numeric_columns(df))
    moments = df.agg(
        *[F.struct(
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(f"m_{c}") for c in cols]
    )
    both = moments.crossJoin(F.broadcast(quantiles(df, cols, [0.25, 0.5, 0.75])))  # 1 row x 1 row
    return _long(
        both,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m_{c}.n").alias("n"),
                F.col(f"m_{c}.mean").alias("mean"),
                F.col(f"m_{c}.std").alias("std"),
                F.col(f"m_{c}.min").alias("min"),
                F.col(c)[0].alias("q25"),
                F.col(c)[1].alias("q50"),
                F.col(c)[2].alias("q75"),
                F.col(f"m_{c}.max").alias("max"),
            )
            for c in cols
        ],
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, NULL left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def grouped_mode(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent value per group, the smallest of tied ones.

    Counting per (group, value) first keeps every buffer small, whatever the
    number of distinct values; a group without any value is absent.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(col).alias("value")))
    return counts.groupBy(*keys).agg(best["value"].alias(col))


#: Columns that are counted together; a row is sent on once for each.
COUNTED_TOGETHER = 32


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value of each column, the smallest of tied ones; None where all are NULL.

    All columns are counted in one scan, each in a grouping set of its own, so values keep
    their type and no buffer holds the values of a column. One row comes to the driver.
    """
    found: dict = {}
    for first in range(0, len(cols), COUNTED_TOGETHER):
        part = list(cols[first : first + COUNTED_TOGETHER])
        names = [f"_mode_{k}" for k in range(len(part))]
        rows = df.select(*[F.col(c).alias(n) for c, n in zip(part, names)])
        counts = rows.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
            F.count("*").alias("_n"), F.grouping_id().alias("_set")
        )
        whole = 2 ** len(names) - 1
        best = [
            F.min(
                F.when(
                    (F.col("_set") == whole - 2 ** (len(names) - 1 - k)) & F.col(n).isNotNull(),
                    F.struct((-F.col("_n")).alias("rank"), F.col(n).alias("value")),
                )
            ).alias(n)
            for k, n in enumerate(names)
        ]
        row = counts.agg(*best).first()
        found |= {c: None if row[n] is None else row[n]["value"] for c, n in zip(part, names)}
    return found


def grouped_max(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(col).alias(col))


def bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column."""
    return df.agg(
        *[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols]
    )


def skewness(df: DataFrame, cols: Sequence[str], adjusted: bool) -> DataFrame:
    """(column, skew): population skewness, or the sample-adjusted one."""
    parts = df.agg(
        *[F.struct(F.skewness(c).alias("g"), F.count(c).cast("double").alias("n")).alias(c)
          for c in cols]
    )
    entries = []
    for c in cols:
        g, n = F.col(c)["g"], F.col(c)["n"]
        correction = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2))
        entries.append(
            F.struct(F.lit(c).alias("column"), (g * correction if adjusted else g).alias("skew"))
        )
    return _long(parts, entries)


def skewed_columns(
    df: DataFrame,
    cols: Sequence[str],
    bias: bool = True,
    threshold: float = SKEW_THRESHOLD,
) -> DataFrame:
    """Columns over the threshold, most skewed first.

    ``bias=True`` fills gaps with the median and takes the size of the population
    skewness; ``bias=False`` takes the signed, sample-adjusted one on present values.
    """
    if bias:
        middle = quantiles(df, cols, [0.5]).first()
        df = df.select(
            *[F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0])).alias(c) for c in cols]
        )
    found = skewness(df, cols, adjusted=not bias)
    if bias:
        found = found.withColumn("skew", F.abs("skew"))
    return found.where(F.col("skew") > threshold).orderBy(F.desc("skew"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long two-way frequency table; no pivot, so any number of categories works."""
    return (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(row, col)
        .agg(F.count("*").alias("n"))
    )


def class_histogram(
    df: DataFrame, label: str, col: str, bins: int, low: float, high: float
) -> DataFrame:
    """Share of each class per equal-width bin. Bin 0 and bin ``bins + 1`` are the tails."""
    counts = (
        df.where(F.col(col).isNotNull())
        .select(
            label,
            F.width_bucket(F.col(col).cast("double"), F.lit(low), F.lit(high), F.lit(bins))
            .alias("bin"),
        )
        .groupBy(label, "bin")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(label))  # at most bins + 2 rows per class
    return counts.select(label, "bin", "n", (F.col("n") / total).alias("share"))


def coverage(df: DataFrame, kept: Column) -> DataFrame:
    """How many rows meet a condition, and their share in percent."""
    return df.agg(
        F.count_if(kept).alias("n_kept"),
        F.count("*").alias("n_rows"),
        (F.try_divide(F.count_if(kept), F.count("*")) * 100).alias("pct_kept"),
    )


def accuracy(prediction: str = "prediction", label: str = "label") -> Column:
    """Aggregate: share of right predictions."""
    return F.avg((F.col(prediction) == F.col(label)).cast("int"))


def rmse(prediction: str = "prediction", label: str = "label") -> Column:
    """Aggregate: root of the mean squared error."""
    error = F.col(prediction) - F.col(label)
    return F.sqrt(F.avg(error * error))


def cv_summary(scores: DataFrame) -> DataFrame:
    """(model, fold, score) to the mean score per model, in percent."""
    return scores.groupBy("model").agg(F.round(F.avg("score") * 100, 2).alias("mean_pct"))
