"""Exact quantiles by one route, whatever the number of rows and the size of a group.

Equal values are counted first. The distinct values are cut, in order of group and
value, into parts of bounded size; parts are summed and only then numbered through,
so neither a hot group nor a narrow range of values meets in one task. Each quantile
is read off where its rank falls.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.order import ROWS_PER_PART, running_sum
from tabforge.session import settle

CELLS = 1024


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """One row per key; each column becomes the array of its linear quantiles.

    NULL values are skipped; a column without values in a group gives NULL. Rows
    with a NULL key are left out. NaN counts as larger than all numbers.
    """
    keys = list(keys)
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if keys:
        df = df.dropna(subset=keys)
    entries = [
        F.struct(F.lit(place).alias("_col"), F.col(c).alias("_value"))
        for place, c in enumerate(cols)
    ]
    series = [*keys, "_col"]
    counted = settle(
        df.select(*keys, F.inline(F.array(*entries)))
        .where("_value IS NOT NULL")
        .groupBy(*series, "_value")
        .agg(F.count("*").alias("_times"))
    )
    parts = max(1, ceil(counted.count() / rows_per_part))
    ranged = counted.withColumn("_in", F.lit(0))
    if parts > 1:
        ranged = counted.repartitionByRange(parts, *series, "_value")
        ranged = settle(ranged.withColumn("_in", F.spark_partition_id()))
    placed = running_sum(ranged, F.col("_times"), F.col("_in"), ["_value"], series, "_from")
    totals = counted.groupBy(*series).agg(F.sum("_times").alias("_n"))

    # Ranks and values meet by stretches of a series' ranks, about ``CELLS`` of them.
    totals = totals.withColumn("_wide", F.greatest(F.lit(1), F.expr(f"_n div {CELLS}")))
    at = F.col("_prob") * (F.col("_n") - 1)
    ranks = (
        totals.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_prob"))
        .select(*series, "_wide", "_i", at.alias("_at"))
        .withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
        .withColumn("_rank", F.explode(F.array_distinct(F.array("_low", "_high"))))
        .withColumn("_cell", F.expr("_rank div _wide"))
    )
    cells = F.expr("sequence(_from div _wide, (_from + _times - 1) div _wide)")
    covering = placed.join(totals, series).select(
        *series, "_value", "_from", "_times", F.explode(cells).alias("_cell")
    )
    at, low, high = F.col("_at"), F.col("_low"), F.col("_high")
    found = (
        covering.join(ranks, [*series, "_cell"])
        .where("_rank >= _from AND _rank < _from + _times")
        .groupBy(*series, "_i", "_at", "_low", "_high")
        .agg(F.min("_value").alias("_lower"), F.max("_value").alias("_upper"))
        .withColumn(
            "_quantile",
            F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise(
                (high - at) * F.col("_lower") + (at - low) * F.col("_upper")
            ),
        )
    )

    def in_order(place: int):
        own = F.when(F.col("_col") == place, F.struct("_i", "_quantile"))
        values = F.transform(F.array_sort(F.collect_list(own)), lambda e: e["_quantile"])
        return F.when(F.size(values) > 0, values)

    table = found.groupBy(*keys).agg(*[in_order(k).alias(c) for k, c in enumerate(cols)])
    return df.select(*keys).distinct().join(table, keys, "left") if keys else table


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    found = quantiles(df, cols, [0.5], keys, **options)
    return found.select(*keys, *[F.col(c)[0].alias(c) for c in cols])


def fitted_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], **options
) -> dict[str, list[float]]:
    """Whole-table quantiles as plain numbers: one row comes to the driver."""
    row = quantiles(df, cols, probs, **options).first()
    return {c: row[c] for c in cols}
