"""Rank of every row among the rows before it, for series of any length.

"How many earlier values are smaller" has no window form. It is the count of :mod:`tickloom.plans.order_index`
over a window that begins with the series: a block, a range of values and a table of counts
answer for a row, so no task holds more of a series than a block of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.order_index import ROWS_PER_BLOCK, OrderIndex, sliding_count
from tickloom.plans.scan import running
from tickloom.plans.slices import position
from tickloom.session import stored

# Blocks of a series; they grow beyond that, since the tables of counts are kept by the driver.
MAX_BLOCKS = 256
RANGES_PER_BLOCK = 4


def prefix_rank(
    df: DataFrame, keys: Sequence[str], order: str, value: str, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Add ``below`` (earlier rows with a smaller value) and ``seen`` (rows up to here).

    ``value`` must be non-null and ``(keys, order)`` unique. Rows without an order come last where they are ranked, and
    first where they are counted.
    """
    at = F.coalesce(position(df, order), F.lit((1 << 63) - 1))
    placed = df.withColumn("_rank_at", at)
    counted = sliding_count(placed, keys, "_rank_at", value, None, strict=True, rows_per_block=rows_per_slice, rows_per_slice=rows_per_slice)
    below = counted.select(*df.columns, F.col("not_above").alias("below"), F.col("known").alias("_rank_at"))
    # Rows of one instant are counted in the order they were ranked in.
    return running(below, list(keys), [order, "_rank_at"], {"seen": ("count", F.col(value))}, rows_per_slice=rows_per_slice).drop("_rank_at")


@dataclass(frozen=True)
class _Bracket:
    """For each block of a column: rows seen before it, the ranges of values its quantiles lie in, and the earlier values below these."""

    cuts: np.ndarray
    seen: np.ndarray
    first: np.ndarray
    last: np.ndarray
    below: np.ndarray


@dataclass(frozen=True)
class _Long:
    """A series of several blocks: where they begin, and a bracket for each column."""

    times: np.ndarray
    brackets: list[_Bracket]


def above_so_far(
    df: DataFrame, key: str, order: str, columns: Sequence[str], q: float, *, rows_per_block: int | None = None
) -> tuple[DataFrame, bool]:
    """``key, order`` and for each column whether it exceeds its interpolated quantile of the rows so far (null where it is null);
    and whether some ``(key, order)`` repeats.

    A value exceeds it exactly when more than q * (m - 1) of the m values so far are smaller. Contiguous blocks cut long series and
    quantiles cut their values into ranges. Counts by block and range say between which ranges the quantile of a
    block's rows lies: about as many earlier values as the block has rows. The block gets only those, and
    decides by comparison for values outside. Rows of one instant are never separated and go by their values. Rows without an order
    have no result, but count as seen; NaN exceeds nothing, but counts as seen. Rows without a key are left out.
    """
    size = rows_per_block or ROWS_PER_BLOCK
    names = [f"_v{i}" for i in range(len(columns))]
    values = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(order).alias("_order"), position(df, order).alias("_at"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names))
    )
    values = stored(values, "values")
    long = _long_series(values, names, q, size)
    sent = df.sparkSession.sparkContext.broadcast(long)
    shape = T.StructType(
        [values.schema["_key"], T.StructField("_block", T.IntegerType()), T.StructField("_role", T.IntegerType()), T.StructField("_n", T.LongType()), *values.schema.fields[1:]]
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            timed = table["_at"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            block, kept = np.zeros(len(timed), np.int32), np.ones(len(timed), bool)
            for name, series, rows in _long_in(table, sent.value):
                kept[rows[~timed[rows]]] = False
                rows = rows[timed[rows]]
                block[rows] = np.searchsorted(series.times, table["_at"].take(pa.array(rows)).to_numpy(), side="right")
                for i, b in enumerate(series.brackets):
                    parts = _earlier(*_column(table, names[i], rows), block[rows], b)
                    if parts:
                        at, value, n = map(np.concatenate, zip(*parts))
                        empty = {f.name: pa.nulls(len(at), f.type) for f in table.schema}
                        own = empty | {"_key": pa.array([name] * len(at), table.schema.field("_key").type), "_v0": pa.array(value)}
                        own |= {"_block": pa.array(at.astype(np.int32)), "_role": pa.array(np.full(len(at), i + 1, np.int32)), "_n": pa.array(n.astype(np.int64))}
                        yield pa.RecordBatch.from_arrays([own[c] for c in shape.names], names=shape.names)
            columns = {c: table[c].combine_chunks() for c in table.column_names}
            columns |= {"_block": pa.array(block), "_role": pa.array(np.where(timed, 0, -1).astype(np.int32)), "_n": pa.array(np.ones(len(timed), np.int64))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in shape.names], names=shape.names).filter(pa.array(kept))

    def decide(table: pa.Table) -> pa.Table:
        name, block = table["_key"][0].as_py(), table["_block"][0].as_py()
        role, n = table["_role"].to_numpy(), table["_n"].to_numpy()
        series, own = sent.value.get(name), np.flatnonzero(role == 0)
        at = table["_at"].take(pa.array(own)).to_numpy()
        out = {"_key": table["_key"].take(pa.array(own)), "_order": table["_order"].take(pa.array(own))}
        for i, c in enumerate(names):
            v, known = _column(table, c, own)
            earlier = np.flatnonzero(role == i + 1)
            if series is None:
                b, seen, below, first, last = None, int(_column(table, c, np.flatnonzero(role == -1))[1].sum()), 0, 0, math.inf
            else:
                b = series.brackets[i]
                seen, below, first, last = b.seen[block], b.below[block], b.first[block], b.last[block]
            rows = np.flatnonzero(known)
            rows = rows[np.lexsort((np.where(np.isnan(v[rows]), -np.inf, v[rows]), at[rows]))]
            number = ~np.isnan(v[rows])
            place = np.cumsum(number) - number
            limit = (seen + np.arange(len(rows))) * q + 1e-9
            within = np.zeros(len(rows), np.int64) if b is None else np.searchsorted(b.cuts, v[rows], side="right")
            above = number & (within > last)
            asking = np.flatnonzero(number & (within >= first) & (within <= last))
            if len(asking):
                x = v[rows[asking]]
                here = OrderIndex(v[rows[number]]).count_not_above(np.zeros(len(asking), np.int64), place[asking], np.nextafter(x, -np.inf))
                past = table["_v0"].take(pa.array(earlier)).to_numpy()
                by_value = np.argsort(past, kind="stable")
                upto = np.concatenate([[0], np.cumsum(n[earlier][by_value])])
                above[asking] = below + upto[np.searchsorted(past[by_value], x, side="left")] + here > limit[asking]
            flags = np.zeros(len(own), bool)
            flags[rows] = above
            out[c] = pa.array(flags, mask=~known)
        again = np.zeros(len(own), bool)
        by_time = np.argsort(at, kind="stable")
        again[by_time[1:]] = at[by_time[1:]] == at[by_time[:-1]]
        return pa.table(out | {"_again": pa.array(again)})

    result = T.StructType([values.schema["_key"], values.schema["_order"], *(T.StructField(c, T.BooleanType()) for c in [*names, "_again"])])
    found = stored(values.mapInArrow(deal, shape).groupBy("_key", "_block").applyInArrow(decide, result), "above")
    flags = found.select(F.col("_key").alias(key), F.col("_order").alias(order), *(F.col(n).alias(c) for c, n in zip(columns, names)))
    return flags, not found.where("_again").isEmpty()


def _column(table: pa.Table, name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of some rows (null: NaN), and which are not null."""
    some = table[name].take(pa.array(rows)).combine_chunks()
    return some.to_numpy(zero_copy_only=False).astype(float), some.is_valid().to_numpy(zero_copy_only=False)


def _long_in(table: pa.Table, long: dict) -> Iterator[tuple]:
    """The long series of a batch, and their rows."""
    if not long:
        return
    keys = table["_key"].combine_chunks().dictionary_encode()
    codes = keys.indices.to_numpy()
    for code, name in enumerate(keys.dictionary.to_pylist()):
        if name in long:
            yield name, long[name], np.flatnonzero(codes == code)


def _earlier(v: np.ndarray, known: np.ndarray, block: np.ndarray, b: _Bracket) -> list[tuple]:
    """``block, value, count`` for each later block whose bracket a value lies in; equal values of a batch are one."""
    parts = []
    number = known & ~np.isnan(v)
    for source in np.unique(block[number]):
        value, n = np.unique(v[number & (block == source)], return_counts=True)
        within = np.searchsorted(b.cuts, value, side="right")
        later = np.arange(source + 1, len(b.seen))
        low, high = np.searchsorted(within, b.first[later], side="left"), np.searchsorted(within, b.last[later], side="right")
        parts += [(np.full(y - x, t), value[x:y], n[x:y]) for t, x, y in zip(later, low, high) if x < y]
    return parts


def _long_series(values: DataFrame, names: list[str], q: float, size: int) -> dict:
    """The series longer than a block: at most rows / size of them, each with a table of counts by block and range."""
    counts = values.groupBy("_key").agg(F.count("_at").alias("n")).where(F.col("n") > size)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return {}
    size = max(size, -(-most // MAX_BLOCKS))
    blocks = -(-most // size)
    ranges = RANGES_PER_BLOCK * blocks
    probs = lambda n: [k / n for k in range(1, n)]
    cuts = lambda c, n: F.percentile_approx(c, probs(n), max(10_000, 20 * n)) if n > 1 else F.array()
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    timeless = lambda c: F.count(F.when(F.col("_at").isNull(), F.col(c)))
    inside = values.join(F.broadcast(counts.select("_key")), "_key", "left_semi")
    facts = inside.groupBy("_key").agg(
        F.count("_at").alias("n"), cuts("_at", blocks).alias("times"),
        *(cuts(number(c), ranges).alias(f"cuts{c}") for c in names), *(timeless(c).alias(f"timeless{c}") for c in names),
    ).collect()
    series = {}
    for r in facts:
        own = min(blocks, -(-r["n"] // size))
        some = lambda edges, n: np.unique([edges[k * (len(edges) + 1) // n - 1] for k in range(1, n)]) if edges and n > 1 else np.zeros(0)
        series[r["_key"]] = (some(r["times"], own), [some(r[f"cuts{c}"], RANGES_PER_BLOCK * own) for c in names])
    numbered = {name: i for i, name in enumerate(series)}
    sent = values.sparkSession.sparkContext.broadcast(series)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            timed = table["_at"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            for name, (times, edges), rows in _long_in(table, sent.value):
                rows = rows[timed[rows]]
                block = np.searchsorted(times, table["_at"].take(pa.array(rows)).to_numpy(), side="right")
                for i, c in enumerate(names):
                    v, known = _column(table, c, rows)
                    # NaN is in the range before the first.
                    place = np.where(np.isnan(v), 0, np.searchsorted(edges[i], v, side="right") + 1)
                    wide = len(edges[i]) + 2
                    cell, n = np.unique(block[known] * wide + place[known], return_counts=True)
                    same = lambda x: np.full(len(cell), x, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (same(numbered[name]), same(i), cell // wide, cell % wide, n)], names=["key", "col", "block", "place", "n"])

    cells = inside.select("_key", "_at", *names).mapInArrow(count, "key long, col long, block long, place long, n long")
    cells = cells.groupBy("key", "col", "block", "place").agg(F.sum("n").alias("n")).toPandas()
    grids = {at: own for at, own in cells.groupby(["key", "col"])}
    out = {}
    for r in facts:
        times, edges = series[r["_key"]]
        brackets = []
        for i, c in enumerate(names):
            grid = np.zeros((len(times) + 1, len(edges[i]) + 2), np.int64)
            own = grids.get((numbered[r["_key"]], i))
            if own is not None:
                grid[own["block"], own["place"]] = own["n"]
            brackets.append(_bracket(grid, edges[i], r[f"timeless{c}"], q))
        out[r["_key"]] = _Long(times, brackets)
    return out


def _bracket(grid: np.ndarray, cuts: np.ndarray, timeless: int, q: float) -> _Bracket:
    rows = grid.sum(1)
    seen = timeless + np.cumsum(rows) - rows
    before = np.cumsum(grid[:, 1:], axis=0) - grid[:, 1:]
    upto = np.concatenate([np.zeros((len(grid), 1), np.int64), np.cumsum(before, axis=1)], axis=1)
    # A row's quantile has this place, from 0, among the values so far: at least so many fewer among the earlier ones as the block adds.
    highest = np.floor(q * (seen + rows)).astype(np.int64) + 1
    lowest = np.minimum(np.floor(q * seen), np.floor(q * (seen + rows)) - rows).astype(np.int64) - 2
    first = np.array([max(0, np.searchsorted(u, low, side="right") - 1) for u, low in zip(upto, lowest)])
    last = np.array([np.searchsorted(u[1:], high + 1, side="left") for u, high in zip(upto, highest)])
    return _Bracket(cuts, seen, first, last, upto[np.arange(len(grid)), first])
