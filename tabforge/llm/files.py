"""Binary files through Spark's own committed writers and readers.

Executors share no local folder and have no handle on the cluster's store, so
bytes go out through the text writer (one row, one piece, one task, one file) and
come back through ``binaryFile``. A task that is lost is simply written again and
only committed files are seen. The writer puts ``SEPARATOR`` behind every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import shared_folder

#: An empty skippable Zstandard frame (magic 0x184D2A50, length 0). It is eight
#: bytes long, so word-aligned files stay aligned and Zstandard readers skip it.
SEPARATOR = b"P*M\x18\x00\x00\x00\x00"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_bytes(pieces: DataFrame, path: str) -> None:
    """One file per partition of ``pieces`` (a single binary column), rows in their order."""
    (column,) = pieces.columns
    pieces.select(F.col(column).cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR.decode()
    ).text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): the files of a folder, numbered by the task that wrote them."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .load(path)
        .where(F.col("length") > 0)
        .select(F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("file"), "content")
    )
