"""Ordered windows over series that are too long for one task.

``Window.partitionBy(symbol)`` gives every symbol one task. With a handful of
symbols, or one symbol holding a third of all rows, that is the bottleneck of
the whole library, so a long series is cut into contiguous slices of about
``rows_per_slice`` rows. Each slice also receives the rows just before it
(``lookback``) and just after it (``lookahead``), so a bounded ROWS frame over
``(key, slice)`` sees exactly the rows it would see over ``key``; the borrowed
rows are dropped afterwards. Nothing is approximated: cut points come from a
hash-selected subset of positions, but the rows between them are counted
exactly and the borrowed range is derived from those counts.

Cost: one count per key (decides whether slicing is needed at all), two scans
of (key, position), then one shuffle of the data on (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import durable

ROWS_PER_SLICE = 1_000_000
CUTS_PER_SLICE = 16
# Upper bound on the broadcast cut table; slices grow when data would exceed it.
MAX_CUTS = 4_000_000

SLICE = "_slice"
BORROWED = "_borrowed"


@dataclass(frozen=True)
class Series:
    """A DataFrame together with the window that walks it in order."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, SLICE) if self.sliced else self.keys

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def owned(self, df: DataFrame) -> DataFrame:
        """Drop borrowed rows once the windows have been evaluated."""
        if not self.sliced:
            return df
        return df.where(~F.col(BORROWED)).drop(SLICE, BORROWED)


def position(df: DataFrame, name: str) -> Column:
    """Numeric form of the ordering column, monotone in it."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(name).cast("long")
    return F.col(name)


def count_not_above(cuts: Column, pos: Column) -> Column:
    """How many sorted ``cuts`` are <= ``pos``, by bisection."""
    def step(state: Column, _: Column) -> Column:
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        goes_right = F.coalesce(F.get(cuts, mid) <= pos, F.lit(False))
        active = state["lo"] < state["hi"]
        return F.struct(
            F.when(active & goes_right, mid + 1).otherwise(state["lo"]).alias("lo"),
            F.when(active & ~goes_right, mid).otherwise(state["hi"]).alias("hi"),
        )

    size = F.coalesce(F.size(cuts), F.lit(0))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(size + 1)).cast("int"), F.lit(1)))
    start = F.struct(
        F.when(size >= 0, F.lit(0)).alias("lo"), F.when(size >= 0, size).alias("hi")
    )
    return F.aggregate(rounds, start, step, lambda state: state["lo"])


def _with_place(df: DataFrame, name: str, pos: Column, rounds: int) -> DataFrame:
    """Add how many of the sorted ``cuts`` are <= ``pos``: as :func:`count_not_above`, but one projection a round, which compiles."""
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(rounds))):
        df = df.withColumn(name, F.col(name) + F.when(F.get("cuts", F.col(name) + (step - 1)) <= pos, step).otherwise(0))
    return df


def _rounds(cuts: DataFrame) -> int:
    """Rounds of bisection for the longest ``cuts``."""
    return (cuts.agg(F.max(F.size("cuts"))).first()[0] or 0).bit_length()


def _slice_table(
    positions: DataFrame, keys: Sequence[str], step: int, rows: int, lookback: int, lookahead: int
) -> DataFrame:
    """One row per long key: cut positions and, per gap between cuts, its slices.

    Holds at most about CUTS_PER_SLICE entries per slice; short keys have no row and are slice 0.
    """
    chosen = F.pmod(F.xxhash64(*keys, "_pos"), F.lit(step)) == 0
    cuts = durable(positions.where(chosen).groupBy(*keys).agg(F.sort_array(F.collect_set("_pos")).alias("cuts")))
    counted = (
        _with_place(positions.join(F.broadcast(cuts), list(keys), "left"), "sub", F.col("_pos"), _rounds(cuts))
        .groupBy(*keys, "sub")
        .agg(F.count("*").alias("n"))
    )
    by_key = Window.partitionBy(*keys)
    walk = by_key.orderBy("sub")
    placed = (
        counted.withColumn("upto", F.sum("n").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn("slice", F.floor(F.col("before") / rows).cast("int"))
        .withColumns({"nxt": F.lead("slice").over(walk), "prv": F.lag("slice").over(walk)})
    )
    last = F.col("slice")
    if lookback:
        reach = by_key.orderBy("upto").rangeBetween(0, lookback - 1)
        last = F.greatest(last, F.max("nxt").over(reach))
    first = F.col("slice")
    if lookahead:
        reach = by_key.orderBy("before").rangeBetween(-(lookahead - 1), 0)
        first = F.least(first, F.min("prv").over(reach))
    spans = (
        placed.select(*keys, "sub", "slice", first.alias("first"), last.alias("last"))
        .groupBy(*keys)
        .agg(
            F.min("sub").alias("base"),
            F.sort_array(F.collect_list(F.struct("sub", "slice", "first", "last"))).alias("spans"),
        )
    )
    return spans.join(cuts, list(keys), "left")


def slice_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lookback: int = 0,
    lookahead: int = 0,
    rows_per_slice: int | None = None,
) -> Series:
    """Cut every long series of ``df`` into slices; short ones stay whole.

    ``order[0]`` decides the cuts; further entries break ties inside a slice.
    Rows sharing one ``(keys, order[0])`` are never separated, which is why the
    canonical bar table keeps that pair unique.
    """
    keys, order = tuple(keys), tuple(order)
    rows = rows_per_slice or ROWS_PER_SLICE
    counts = df.groupBy(*keys).count()
    size = counts.agg(F.max("count").alias("longest"), F.sum("count").alias("total")).first()
    if (size["longest"] or 0) <= 2 * rows:
        return Series(df, keys, order, False)
    rows = max(rows, CUTS_PER_SLICE * size["total"] // MAX_CUTS)
    step = max(rows // CUTS_PER_SLICE, 1)
    # Only series longer than two slices are cut: at most total / (2 * rows) of them.
    long_keys = F.broadcast(durable(counts.where(F.col("count") > 2 * rows).select(*keys)))
    positions = df.select(*keys, position(df, order[0]).alias("_pos")).join(long_keys, list(keys), "left_semi")
    # Small and used by every later evaluation of the result, so computed once.
    table = durable(_slice_table(positions, keys, step, rows, lookback, lookahead))
    sliced = (
        _with_place(df.withColumn("_pos", position(df, order[0])).join(F.broadcast(table), list(keys), "left"), "_sub", F.col("_pos"), _rounds(table))
        .withColumn("_span", F.get("spans", F.col("_sub") - F.col("base")))
        .withColumn(SLICE, F.explode(F.sequence(F.coalesce("_span.first", F.lit(0)), F.coalesce("_span.last", F.lit(0)))))
        .withColumn(BORROWED, F.col(SLICE) != F.coalesce("_span.slice", F.lit(0)))
        .drop("_pos", "_sub", "cuts", "spans", "base", "_span")
    )
    return Series(sliced, keys, order, True)
