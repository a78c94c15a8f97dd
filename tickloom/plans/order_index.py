"""Rank of every row within a long sliding window: an order-statistic index over blocks of a series.

"How many of the last n values are not above mine" has no window form, and a frame of n rows read again
for every row costs n. Here positions cut each series into blocks, and quantiles cut its values into ranges of about
as many rows. The window of a row is the end of an older block, some whole blocks, and the beginning of its own. Each end
is one lookup in the index of that block. In the whole blocks, the values of lower ranges are read off a table of
counts by block and range, and those of the row's own range are one lookup in the index of that range.
So a row travels to three groups at most however long the window is, and no group outgrows a block or a range. A value
that fills ranges by itself has one of its own, which the table answers alone.

The index of a group is its ranks split bit by bit (zeros kept before ones, order kept), with
the number of zeros before each place: a range of places is followed down the bits, and wherever the sought
rank has a one, the zeros of the range are smaller.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.scan import running
from tickloom.plans.slices import count_not_above
from tickloom.session import stored

ROWS_PER_BLOCK = 1 << 17
# A range of values holds about 2 ** MERGES blocks of rows.
MERGES = 0
# Tables of counts of up to so many cells go to every task.
BROADCAST_CELLS = 1 << 21


class OrderIndex:
    """Counts of values not above a bound within any range of places."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values)
        ranks = np.searchsorted(self.sorted, values, side="left")
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in reversed(range(max(len(values) - 1, 1).bit_length())):
            ones = (ranks >> bit & 1).astype(bool)
            zeros_before = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros_before))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def count_not_above(self, low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each query: how many of the places ``low <= p < high`` hold a value <= its bound."""
        # Ranks start at the first of equal values, so values <= bound have ranks below this one.
        rank = np.searchsorted(self.sorted, bounds, side="right")
        whole = rank >= len(self.sorted)
        rank = np.minimum(rank, max(len(self.sorted) - 1, 0))
        left, right = low.copy(), high.copy()
        count = np.zeros(len(bounds), np.int64)
        for bit, zeros_before in self.levels:
            zeros = zeros_before[-1]
            a, b = zeros_before[left], zeros_before[right]
            one = (rank >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            left, right = np.where(one, zeros + left - a, a), np.where(one, zeros + right - b, b)
        return np.where(whole, high - low, count)


def sliding_count(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    window: int | None,
    *,
    strict: bool = False,
    rows_per_block: int | None = None,
    merges: int = MERGES,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add ``not_above`` and ``known``: of the last ``window`` rows (None: all so far), those with ``value`` <= the row's own
    (``strict``: below it, rows that share an order by their values), and those with a value.

    Null where the window is not full yet. ``(keys, order)`` must be unique; a null value (NaN counts as one) is in no count
    and has 0 for ``not_above``.
    """
    keys, columns = list(keys), df.columns
    size = rows_per_block or ROWS_PER_BLOCK
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    names = [f"_key{i}" for i in range(len(keys))]
    # The row itself travels in a box, so its columns may have any names.
    boxed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"),
        *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)),
        F.col(f"`{order}`").alias("_at"),
        number(value).alias("_value"),
        F.lit(1).alias("_one"),
    )
    placed = running(boxed, names, ["_at", "_value"] if strict else ["_at"], {"_upto": ("sum", F.col("_one"))}, rows_per_slice=rows_per_slice)
    place = F.col("_upto") - 1
    start = F.lit(0).cast("long") if window is None else F.greatest(place - window + 1, F.lit(0))
    rows = placed.select("_row", *names, "_value", place.alias("_place"), F.floor(place / size).alias("_own"), start.alias("_from"))
    rows = stored(rows, "places")
    full = F.lit(True) if window is None else F.col("_place") >= window - 1
    rows = _whole_blocks(rows, names, size, size << merges, full, strict)
    asks = lambda kind, node, low, high, role: F.struct(
        F.lit(kind).alias("kind"), node.cast("long").alias("node"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(role).alias("role")
    )
    zero, nothing = F.lit(0), F.array().cast("array<struct<kind:int,node:bigint,low:bigint,high:bigint,role:int>>")
    own = F.array(asks(0, F.col("_own"), F.greatest(F.col("_from") - F.col("_own") * size, zero), zero, 0))
    old = F.floor(F.col("_from") / size)
    far = F.when(full & (old < F.col("_own")) & (F.col("_from") > old * size), F.array(asks(0, old, F.col("_from") - old * size, zero, 1))).otherwise(nothing)
    among = F.when(F.col("_range").isNotNull() & ~F.col("_single"), F.array(asks(1, F.col("_range"), F.col("_first") * size, F.col("_last") * size, 2))).otherwise(nothing)
    out = rows.withColumn("_ask", F.explode(F.concat(own, far, among)))
    at_home = lambda c: F.when(F.col("_ask.role") == 0, F.col(c)).alias(c)
    sent = out.select(
        *names, F.col("_ask.kind").alias("_kind"), F.col("_ask.node").alias("_node"), F.col("_ask.role").alias("_role"), F.col("_ask.low").alias("_low"),
        F.col("_ask.high").alias("_high"), "_place", "_value", *(at_home(c) for c in ("_row", "_base", "_base_n")),
    )
    shape = T.StructType([*(sent.schema[n] for n in [*names, "_place", "_row"]), T.StructField("_count", T.LongType()), T.StructField("_n", T.LongType())])

    def count(table: pa.Table) -> pa.Table:
        role, low, high, pos = (table[c].to_numpy() for c in ("_role", "_low", "_high", "_place"))
        values = table["_value"].to_numpy(zero_copy_only=False).astype(float)  # null: NaN
        known = ~np.isnan(values)
        block = table["_kind"][0].as_py() == 0
        held = np.flatnonzero(known & (role == 0) if block else known)
        held = held[np.argsort(pos[held], kind="stable")]
        asking = np.arange(len(values)) if block else np.flatnonzero(low < high)
        bounds = np.where(known[asking], values[asking], -np.inf)
        if strict:
            bounds = np.nextafter(bounds, -np.inf)
        places = pos[held] - (table["_node"][0].as_py() * size if block else 0)
        start = np.searchsorted(places, low[asking])
        if block:
            upto = np.searchsorted(places, pos[asking] - table["_node"][0].as_py() * size, side="right")
            end = np.where(role[asking] == 0, upto, len(held))
        else:
            end = np.searchsorted(places, high[asking])
        counts = np.where(known[asking], OrderIndex(values[held]).count_not_above(start, end, bounds), 0)
        seen = end - start if block else np.zeros(len(asking), np.int64)
        extra = [table[c].take(pa.array(asking)).fill_null(0).to_numpy() for c in ("_base", "_base_n")]
        kept = table.select([*names, "_place", "_row"]).take(pa.array(asking))
        return kept.append_column("_count", pa.array((counts + extra[0]).astype(np.int64))).append_column("_n", pa.array((seen + extra[1]).astype(np.int64)))

    parts = sent.groupBy(*names, "_kind", "_node").applyInArrow(count, shape)
    whole = parts.groupBy(*names, "_place").agg(F.first("_row", ignorenulls=True).alias("_row"), F.sum("_count").alias("_count"), F.sum("_n").alias("_n"))
    return whole.select("_row.*", F.when(full, F.col("_count")).alias("not_above"), F.when(full, F.col("_n")).alias("known"))


def _whole_blocks(rows: DataFrame, names: list[str], size: int, rows_per_range: int, full: Column, strict: bool) -> DataFrame:
    """Add what lies in the whole blocks ``_first <= block < _last`` of a row's window: ``_base``, the values of lower ranges (all
    that count, where the row's range is a ``_single`` value), ``_base_n``, the known values, and the row's ``_range``.

    ``_range`` is null in series of one block, which hold no whole ones.
    """
    lengths = rows.groupBy(*names).agg(F.count("*").alias("n"), F.count("_value").alias("known")).where(F.col("n") > size)
    total = lengths.agg(F.sum("n"), F.max("known")).first()
    none = {"_first": "long", "_last": "long", "_range": "int", "_base": "long", "_base_n": "long", "_single": "boolean"}
    if total[0] is None:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    ranges = max(1, -(-total[1] // rows_per_range))
    probs = [k / ranges for k in range(1, ranges)]
    edges = F.percentile_approx("_value", probs, max(10_000, 20 * ranges)) if probs else F.lit(None).cast("array<double>")
    # Some edges for each block of a long series: these are few.
    found = rows.groupBy(*names).agg(F.count("*").alias("n"), edges.alias("edges")).where(F.col("n") > size).collect()
    cuts = [(*(r[n] for n in names), *_cuts(r["edges"] or [])) for r in found]
    own = T.StructType([*(T.StructField(f"_c{i}", rows.schema[n].dataType) for i, n in enumerate(names)), T.StructField("_cuts", T.ArrayType(T.DoubleType())), T.StructField("_singles", T.ArrayType(T.BooleanType()))])
    local = rows.sparkSession.createDataFrame(cuts, own)
    same = lambda prefix: reduce(and_, (F.col(n).eqNullSafe(F.col(f"{prefix}{i}")) for i, n in enumerate(names)), F.lit(True))
    marked = rows.join(F.broadcast(local), same("_c"), "left")
    inside = F.col("_value").isNotNull() & F.col("_cuts").isNotNull()
    marked = marked.withColumn("_range", F.when(inside, count_not_above(F.col("_cuts"), F.col("_value"))).cast("int"))
    marked = marked.withColumn("_single", F.coalesce(F.get("_singles", F.col("_range")), F.lit(False)))
    cells = marked.where(F.col("_cuts").isNotNull()).groupBy(*names, "_own", F.coalesce("_range", F.lit(-1)).alias("_range")).agg(F.count("_value").alias("_n"))
    shape = T.StructType([*(rows.schema[n] for n in names), T.StructField("_block", T.LongType()), T.StructField("_below", T.ArrayType(T.LongType()))])

    def before(table: pa.Table) -> pa.Table:
        block, place, n = (table[c].to_numpy() for c in ("_own", "_range", "_n"))
        grid = np.zeros((block.max() + 2, max(place.max(), 0) + 2), np.int64)
        some = place >= 0
        grid[block[some] + 1, place[some] + 1] = n[some]
        grid = grid.cumsum(0).cumsum(1)[:-1]
        offsets = np.arange(len(grid) + 1, dtype=np.int32) * grid.shape[1]
        own = table.select(names).slice(0, 1).take(pa.array(np.zeros(len(grid), np.int64)))
        below = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grid.ravel()))
        return own.append_column("_block", pa.array(np.arange(len(grid)))).append_column("_below", below)

    counts = stored(cells.groupBy(*names).applyInArrow(before, shape), "counts-before")
    few = (total[0] // size + len(found)) * 2 * ranges <= BROADCAST_CELLS

    def looked_up(frame: DataFrame, at: str, prefix: str) -> DataFrame:
        side = counts.select(*(F.col(n).alias(f"{prefix}{i}") for i, n in enumerate(names)), F.col("_block").alias(f"{prefix}_block"), F.col("_below").alias(f"{prefix}_below"))
        return frame.join(F.broadcast(side) if few else side, same(prefix) & (F.col(at) == F.col(f"{prefix}_block")), "left")

    marked = marked.withColumns({"_first": F.ceil(F.col("_from") / size), "_last": F.when(full, F.col("_own")).otherwise(F.lit(0))})
    some = F.col("_first") < F.col("_last")
    marked = looked_up(looked_up(marked.withColumn("_need", F.when(some, F.col("_first"))).withColumn("_upto", F.when(some, F.col("_last"))), "_need", "_p"), "_upto", "_q")
    upto = F.col("_range") if strict else F.col("_range") + F.col("_single").cast("int")
    between = lambda i: F.get("_q_below", i) - F.get("_p_below", i)
    marked = marked.withColumns({"_base": between(upto), "_base_n": between(F.size("_q_below") - 1)})
    return marked.select(*rows.columns, *none)


def _cuts(edges: Sequence[float]) -> tuple[list[float], list[bool]]:
    """Lower ends of all ranges but the first, and which ranges hold a single value: those that several edges fell on."""
    cuts, heavy = sorted(set(edges)), {a for a, b in zip(edges, edges[1:]) if a == b and math.isfinite(a)}
    cuts = sorted({*cuts, *(math.nextafter(c, math.inf) for c in heavy)})
    return cuts, [False, *(c in heavy for c in cuts)]
