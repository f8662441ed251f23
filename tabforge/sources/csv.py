"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere below the scan; NaN never gets past it."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, null_value: str = ""
) -> DataFrame:
    """Read a headed CSV with quoted fields; empty text (or ``null_value``) is NULL.

    The schema may name more columns than one file holds (a test split has no
    label): columns are matched to the header, absent ones come back as NULL.
    The line separator stays unset, so CR LF and CR CR LF endings both read well.
    """
    reader = spark.read.option("quote", '"').option("escape", '"')
    header = reader.option("header", True).csv(path).columns
    fields = {field.name: field for field in schema.fields}
    unknown = [name for name in header if name not in fields]
    if unknown:
        raise ValueError(f"columns not in the schema: {unknown}")
    present = T.StructType([fields[name] for name in header])
    df = (
        reader.schema(present)
        .option("header", True)
        .option("nullValue", null_value)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    absent = [field for field in schema.fields if field.name not in header]
    for field in absent:
        df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return nan_to_null(df.select(*[f"`{name}`" for name in schema.names]))


def write_predictions(df: DataFrame, path: str, id_col: str, pred_col: str) -> None:
    """Write ``(id, prediction)`` with a header; booleans become True / False."""
    prediction = F.col(pred_col)
    if isinstance(df.schema[pred_col].dataType, T.BooleanType):
        prediction = F.initcap(prediction.cast("string"))
    df.select(F.col(id_col), prediction.alias(pred_col)).write.mode("overwrite").csv(
        path, header=True
    )
