"""Numeric column functions. NULL is kept unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REFERENCE_YEAR = 2010
ANSWER_MAX = 99999
AGE_EDGES = (16, 26, 36, 62)
FARE_EDGES = (17, 30, 100)
REGION_EDGES = (-1, 300, 600, 1000, 1500, 2500)
DEFAULT_DECK_LENGTH = 2000


def clip_upper(col: Column, cap) -> Column:
    """Not ``least``, which would turn NULL into the cap."""
    return F.when(col > cap, cap).otherwise(col)


def clip_lower(col: Column, low) -> Column:
    return F.when(col < low, low).otherwise(col)


def log_pos(col: Column) -> Column:
    return F.when(col > 0, F.ln(col)).otherwise(F.lit(0.0))


def invert_log_target(col: Column) -> Column:
    return F.expm1(col)


def row_sum(cols: Iterable[Column]) -> Column:
    """Sum over the row that counts NULL as 0."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in cols])


def lin_comb(cols: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted sum that is NULL as soon as one part is."""
    weights = weights or [1] * len(cols)
    return reduce(add, [c if w == 1 else c * F.lit(w) for c, w in zip(cols, weights)])


def safe_ratio(num: Column, den: Column) -> Column:
    """Share with a +1 guard in the denominator."""
    return F.try_divide(num, den + 1)


def spend_power(total: Column, age: Column, age_median) -> Column:
    """Spend per year of age; unknown age is the median, infants count as one year."""
    years = clip_lower(F.coalesce(age, F.lit(age_median)), F.lit(1.0))
    return total / years


def relative_position(num: Column, group_max: Column, default=DEFAULT_DECK_LENGTH) -> Column:
    """Position over the fitted group maximum; a maximum of 0 gives NULL."""
    return F.try_divide(num, F.coalesce(group_max, F.lit(float(default))))


def years_since(year: Column, reference: int = REFERENCE_YEAR) -> Column:
    return F.lit(reference) - year


def bin_right(col: Column, edges: Sequence[float], open_ends: bool = True, other=None) -> Column:
    """Bin number with right-closed bins ``(a, b]``.

    With ``open_ends`` everything up to the first edge is bin 0 and everything
    above the last edge is the last bin. Without, values outside the edges (and
    NULL) give ``other``.
    """
    if open_ends:
        case = F.when(col.isNull(), F.lit(other).cast("int"))
        for number, edge in enumerate(edges):
            case = case.when(col <= edge, number)
        return case.otherwise(len(edges))
    case = F.when(col.isNull() | (col <= edges[0]), F.lit(other).cast("int"))
    for number, edge in enumerate(edges[1:]):
        case = case.when(col <= edge, number)
    return case.otherwise(F.lit(other).cast("int"))


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clamp_answer(col: Column, high: int = ANSWER_MAX) -> Column:
    """Integer answer in [0, high]; text that is no number gives 0."""
    return F.greatest(F.lit(0), F.least(F.lit(high), F.coalesce(col.try_cast("bigint"), F.lit(0))))


def fill_const(col: Column, value) -> Column:
    return F.coalesce(col, F.lit(value))


def set_where(col: Column, condition: Column, value) -> Column:
    """Overwrite the rows that meet the condition, keep the rest (NULL condition: keep)."""
    return F.when(condition, F.lit(value)).otherwise(col)
