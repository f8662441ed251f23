"""Running totals, ranks and balanced folds without one global or hot window.

Rows are cut into ordered parts of bounded size. The parts are summed, the few
part sums are accumulated, and each part then only needs its own window.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import settle

ROWS_PER_PART = 1_000_000


def hash32(row_id: Column, seed: int) -> Column:
    """Uniform number in [0, 2**32) that depends on the key and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def running_sum(
    df: DataFrame, value: Column, part: Column, order: Sequence[str], keys: Sequence[str], out: str
) -> DataFrame:
    """Sum of all earlier rows of the key. ``part`` must grow with ``order``.

    Rows whose key is NULL are a group of their own.
    """
    keys = list(keys)
    rows = df.withColumn("_part", part).withColumn("_add", value)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_part")
        .agg(F.sum("_add").alias("_sum"))
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col("_part").alias("_of_part"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
        )
    )
    same = F.col("_part") == F.col("_of_part")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    within = (
        Window.partitionBy(*keys, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(starts, same)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_add").over(within), F.lit(0)))
        .drop("_part", "_add", "_start", "_of_part", *[f"_of_{k}" for k in keys])
    )


def _range_parts(df: DataFrame, order: str, rows_per_part: int) -> DataFrame:
    """Number the parts of a range partitioning, and settle it so numbers never move."""
    parts = max(1, ceil(df.count() / rows_per_part))
    if parts == 1:
        return df.withColumn("_range", F.lit(0))
    return settle(
        df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id())
    )


def running_total(
    df: DataFrame, order: str, col: str, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Per value of ``order``: its own sum, and the total of everything before it.

    Rows with the same ``order`` are peers and are summed first, so a value held
    by very many rows is one row here.
    """
    peers = df.groupBy(order).agg(F.sum(col).alias(col))
    ranged = _range_parts(peers, order, rows_per_part)
    return running_sum(
        ranged, F.col(col), F.col("_range"), [order], [], "total_before"
    ).drop("_range")


def category_codes(
    df: DataFrame, col: str, out: str = "code", rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """(value, code): position of each distinct value in sorted order, from 0."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    ranged = _range_parts(values, col, rows_per_part)
    codes = running_sum(ranged, F.lit(1), F.col("_range"), [col], [], out)
    return codes.select(col, F.col(out).cast("int").alias(out))


def kfold(df: DataFrame, key: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Shuffled folds from the key alone: no shuffle, same fold on every run."""
    return df.withColumn(out, F.pmod(hash32(F.col(key), seed), F.lit(k)).cast("int"))


def stratified_kfold(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    seed: int,
    out: str = "fold",
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Deal the shuffled rows of each class to the folds in turn.

    Fold sizes differ by at most one per class. The hash is uniform, so its
    leading range cuts even one dominant class into parts of equal size.
    """
    parts = max(1, ceil(df.count() / rows_per_part))
    rows = df.withColumn("_hash", hash32(F.col(key), seed))
    part = F.floor(F.col("_hash") * parts / 2**32)
    ranked = running_sum(rows, F.lit(1), part, ["_hash", key], [label], "_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop(
        "_hash", "_rank"
    )
