"""Column functions over names, cabins and composite ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TITLE_PATTERN = r" ([A-Za-z]+)\."
NO_CABIN = "T/0/P"
NO_NAME = "Unknown Unknown"
NO_DECK = "M"


def extract_title(name: Column, empty_as_null: bool = False) -> Column:
    """First honorific in ``Last, Title. First``; no match gives '' or NULL."""
    title = F.regexp_extract(name, TITLE_PATTERN, 1)
    return F.nullif(title, F.lit("")) if empty_as_null else title


def deck_letter(cabin: Column, missing: str | None = NO_DECK) -> Column:
    letter = F.substring(cabin, 1, 1)
    return letter if missing is None else F.coalesce(letter, F.lit(missing))


def parse_cabin(cabin: Column, missing: str = NO_CABIN) -> Column:
    """``Deck/Num/Side`` as a struct; short or malformed parts are NULL, never an error."""
    parts = F.split(F.coalesce(cabin, F.lit(missing)), "/")
    return F.struct(
        F.get(parts, F.lit(0)).alias("deck"),
        F.get(parts, F.lit(1)).try_cast("double").alias("num"),
        F.get(parts, F.lit(2)).alias("side"),
    )


def parse_group(row_id: Column) -> Column:
    """``gggg_pp`` as a struct of the group text and the member number."""
    parts = F.split(row_id, "_")
    return F.struct(
        F.get(parts, F.lit(0)).alias("group"),
        F.get(parts, F.lit(1)).try_cast("int").alias("member"),
    )


def surname(name: Column, missing: str = NO_NAME) -> Column:
    """Last space-separated word of a name."""
    return F.element_at(F.split(F.coalesce(name, F.lit(missing)), " "), -1)


def concat_cols(*cols: Column) -> Column:
    """Interaction of two or more codes; NULL if any part is."""
    return F.concat(*cols)
