"""Arithmetic with one missing-value rule: undefined results are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division whose zero denominator gives NULL (ANSI mode would raise)."""
    return F.try_divide(col(numerator), col(denominator))


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_if(condition: Column) -> Column:
    """Number of rows where the condition holds, as bigint, 0 on empty input."""
    return F.count(F.when(condition, F.lit(1)))


def rounded(value: Column | str, places: int = 6) -> Column:
    """Round and normalise negative zero."""
    return F.round(col(value), places) + F.lit(0.0)


def clip(value: Column, low: Column, high: Column) -> Column:
    """Clamp; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))
