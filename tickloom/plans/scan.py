"""Cumulative aggregates (running sum, peak, count) that scale past one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.slices import BORROWED, SLICE, slice_series

_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _latest(column: str) -> Column:
    return F.last(column, ignorenulls=True)


def _slice_total(kind: str, column: str, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    return _AGGREGATE[kind](column)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry + local, carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add running aggregates from the start of each series to the current row.

    ``measures`` maps an output name to ``(kind, column)`` with kind one of
    sum, count, max, min, last (the last known value: that of the latest row that has one). A short series is one plain window. A long one is
    scanned in two levels: aggregate per slice, prefix over the slice totals
    (one row per slice), then a window inside each slice plus its carry.
    """
    inputs = {f"_in_{name}": value for name, (_, value) in measures.items()}
    series = slice_series(df.withColumns(inputs), keys, order, rows_per_slice=rows_per_slice)
    upto_here = series.window.rowsBetween(Window.unboundedPreceding, 0)
    local = {
        name: _AGGREGATE.get(kind, _latest)(f"_in_{name}").over(upto_here) for name, (kind, _) in measures.items()
    }
    if not series.sliced:
        return series.df.withColumns(local).drop(*inputs)
    totals = series.df.groupBy(*series.partition).agg(
        *(_slice_total(kind, f"_in_{name}", order).alias(name) for name, (kind, _) in measures.items())
    )
    earlier = Window.partitionBy(*series.keys).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    fold = {"count": F.sum, "last": _latest}
    carry = totals.select(
        *series.partition,
        *(
            (fold.get(kind) or _AGGREGATE[kind])(name).over(earlier).alias(f"_carry_{name}")
            for name, (kind, _) in measures.items()
        ),
    )
    # Slice 0 carries nothing, and short series have no other: one row per further slice of a long
    # one, at most rows / rows_per_slice.
    carry = carry.where(F.col(SLICE) > 0)
    joined = series.df.join(F.broadcast(carry), list(series.partition), "left").withColumns(local)
    combined = {
        name: _combine(kind, F.col(f"_carry_{name}"), F.col(name))
        for name, (kind, _) in measures.items()
    }
    return joined.withColumns(combined).drop(
        SLICE, BORROWED, *inputs, *(f"_carry_{name}" for name in measures)
    )
