"""Reusable column expressions. None of them depends on the session time zone."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.params import GRANULARITIES

SECONDS_PER_DAY = 86400.0


def period_start(unit: str, ts: Column | str) -> Column:
    """First instant of the day, ISO week, month, quarter or year of a timestamp."""
    if unit not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, not {unit!r}")
    day = F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Exact decimal seconds. Summed as decimals it neither rounds nor overflows."""
    gap = _col(later) - _col(earlier)
    return gap.cast("interval second").cast("decimal(20,6)")


def whole_days(earlier: Column | str, later: Column | str) -> Column:
    """Day part of the gap, truncated toward zero."""
    return F.extract(F.lit("DAY"), _col(later) - _col(earlier)).cast("bigint")


def cents(*amounts: Column) -> Column:
    """Whole cents of the sum of two-decimal amounts.

    Sums of cents are exact, stay in generated code, shuffle in 8 bytes, and fail rather
    than wrap when they overflow. An amount has at most ten digits, so the double product
    is within a thousandth of the whole number it is rounded to.
    """
    total = sum((a.cast("double") for a in amounts[1:]), amounts[0].cast("double"))
    return F.rint(total * 100).cast("bigint")


def amount(total_cents: Column | str) -> Column:
    """The double nearest to an exact sum of cents."""
    return (_col(total_cents).cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("double")


def as_double(col: Column | str) -> Column:
    return _col(col).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; NULL when the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def exact_mean(col: Column | str) -> Column:
    """Mean from an exact sum, so partitioning cannot change the last digits."""
    return ratio(F.sum(col), F.count(col))


def mean_days(seconds: Column | str) -> Column:
    return exact_mean(seconds) / F.lit(SECONDS_PER_DAY)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, _col(value)))


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row frame as a struct column, through one scalar subquery.

    A subquery per field would run the one-row frame again for each of them.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
