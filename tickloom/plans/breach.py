"""The first later row of a series that crosses a price level, however far away.

Each slice answers for its own rows in numpy (block minima, then one block). A level not
crossed there is looked up in a table of one row per slice (lowest and highest
price, whether a stop signal occurs), which names the first later slice that
crosses it; the search then runs once more inside that slice. Two passes reach any
distance, nothing is kept per row, and no horizon is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.slices import BORROWED, ROWS_PER_SLICE, SLICE, slice_series
from tickloom.plans.small import join_small

BLOCK = 64
CHUNK = 8192


def first_at_or_below(values: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each query the first index >= ``start`` whose value is <= ``level``; ``len(values)`` if none. NaN never crosses."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.full((blocks + 1) * BLOCK, np.inf)
    padded[:n] = np.where(np.isnan(values), np.inf, values)
    grid = padded.reshape(-1, BLOCK)
    lows = [grid[:blocks].min(1) if blocks else np.zeros(0)]
    while len(lows[-1]) > 1:
        step = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-step], lows[-1][step:]) if len(lows[-1]) > step else np.zeros(0))
        if not len(lows[-1]):
            lows.pop()
            break
    out = np.full(len(start), n, np.int64)
    for at in range(0, len(start), CHUNK):
        s, lv = start[at : at + CHUNK], level[at : at + CHUNK]
        block = np.minimum(s // BLOCK, blocks)
        inside = (grid[block] <= lv[:, None]) & (np.arange(BLOCK)[None, :] >= (s - block * BLOCK)[:, None])
        hit = inside.any(1)
        found = np.where(hit, block * BLOCK + inside.argmax(1), n)
        rest = np.flatnonzero(~hit)
        b = block[rest] + 1
        for k in range(len(lows) - 1, -1, -1):
            fits = b + (1 << k) <= blocks
            skip = np.zeros(len(b), bool)
            skip[fits] = lows[k][b[fits]] > lv[rest][fits]
            b = np.where(skip, b + (1 << k), b)
        there = b < blocks
        inside = grid[np.minimum(b, blocks)] <= lv[rest][:, None]
        found[rest] = np.where(there & inside.any(1), b * BLOCK + inside.argmax(1), n)
        out[at : at + CHUNK] = found
    return np.minimum(out, n)


def _search(bars: tuple, start: np.ndarray, entry: np.ndarray, stops: Sequence[float], targets: Sequence[float]) -> list[np.ndarray]:
    """Index of the first crossing per mark: stops, then targets, then the sell signal."""
    close, sell = bars
    marks = [first_at_or_below(close, start, entry * (1 - s)) for s in stops]
    marks += [first_at_or_below(-close, start, -(entry * (1 + t))) for t in targets]
    where = np.append(np.flatnonzero(sell), len(close))
    return [*marks, where[np.searchsorted(where, start)]]


MARK = "struct<ts: long, close: double>"


def first_breaches(
    labelled: DataFrame, stops: Sequence[float], targets: Sequence[float], *, rows_per_slice: int | None = None
) -> DataFrame:
    """One row per buy: ``symbol, ts, close, marks``; ``marks`` lists (ts, close) of the first later
    bar at or below each stop, at or above each target, and of the first later sell (null where there is none)."""
    series = slice_series(
        labelled.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "close", "signal"),
        ["symbol"], ["ts"], rows_per_slice=rows_per_slice,
    )
    bars = series.df if series.sliced else series.df.withColumns({SLICE: F.lit(0), BORROWED: F.lit(False)})
    bars = bars.where(~F.col(BORROWED)).select("symbol", SLICE, "ts", "close", F.coalesce(F.col("signal") == "sell", F.lit(False)).alias("sell"), (F.col("signal") == "buy").alias("buy"))
    kind = f"symbol {labelled.schema['symbol'].dataType.simpleString()}, {SLICE} int, ts long, close double, marks array<{MARK}>"
    mark_type = pa.list_(pa.struct([("ts", pa.int64()), ("close", pa.float64())]))

    def answers(symbol, slices, ts, close, found: list[np.ndarray], bar_ts: np.ndarray, bar_close: np.ndarray) -> pa.Table:
        # Two flat columns of (entry, mark) in order, cut into lists by offsets.
        n = len(bar_ts)
        at = np.stack(found, axis=1).ravel() if found else np.zeros(0, np.int64)
        none = at >= n
        at = np.where(none, 0, at)
        taken = lambda values: values[at] if n else np.zeros(len(at), values.dtype)
        marks = pa.StructArray.from_arrays([pa.array(taken(bar_ts)), pa.array(taken(bar_close))], fields=list(mark_type.value_type), mask=pa.array(none))
        offsets = np.arange(len(ts) + 1, dtype=np.int32) * len(found)
        return pa.table({
            "symbol": symbol, SLICE: pa.array(slices, pa.int32()), "ts": pa.array(ts, pa.int64()),
            "close": pa.array(close, pa.float64()), "marks": pa.ListArray.from_arrays(pa.array(offsets), marks),
        })

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        ts, close = table["ts"].to_numpy(), table["close"].to_numpy()
        buys = np.flatnonzero(table["buy"].fill_null(False).to_numpy())
        found = _search((close, table["sell"].to_numpy()), buys + 1, close[buys], stops, targets)
        return answers(table["symbol"].take(pa.array(buys)), table[SLICE].to_numpy()[buys], ts[buys], close[buys], found, ts, close)

    first = bars.groupBy("symbol", SLICE).applyInArrow(own, kind)
    if not series.sliced:
        return first.select("symbol", "ts", "close", "marks")
    # One row per symbol holding one entry per slice.
    span = bars.groupBy("symbol", SLICE).agg(F.min("close").alias("low"), F.max("close").alias("high"), F.max("sell").alias("sell"))
    spans = span.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(SLICE, "low", "high", "sell"))).alias("spans"))
    entries = join_small(first, spans, ["symbol"])
    tests = [lambda s, x=x: s["low"] <= F.col("close") * (1 - x) for x in stops]
    tests += [lambda s, x=x: s["high"] >= F.col("close") * (1 + x) for x in targets]
    tests += [lambda s: s["sell"]]

    def next_slice(m: int, test) -> F.Column:
        later = F.filter("spans", lambda s: (s[SLICE] > F.col(SLICE)) & test(s))
        return F.when(F.get("marks", F.lit(m)).isNull(), F.get(later, F.lit(0))[SLICE])

    wanted = entries.withColumn("next", F.array(*(next_slice(m, t) for m, t in enumerate(tests)))).drop("spans")
    # (entry, slice) pairs, at most one per mark; a slice many entries look into is dealt over salts.
    asked = wanted.select("symbol", "ts", "close", F.explode(F.array_distinct(F.array_compact("next"))).alias(SLICE))
    limit = rows_per_slice or ROWS_PER_SLICE
    load = asked.groupBy("symbol", SLICE).agg(F.ceil(F.count("*") / limit).cast("int").alias("salts"))
    asked = join_small(asked, load, ["symbol", SLICE]).withColumn("salt", F.pmod(F.xxhash64("ts"), "salts").cast("int")).drop("salts")
    ahead = join_small(bars, load, ["symbol", SLICE], "inner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def beyond(queries: pa.Table, slice_: pa.Table) -> pa.Table:
        slice_ = slice_.sort_by("ts")
        ts, close = slice_["ts"].to_numpy(), slice_["close"].to_numpy()
        entry = queries["close"].to_numpy()
        found = _search((close, slice_["sell"].to_numpy()), np.zeros(len(entry), np.int64), entry, stops, targets)
        return answers(queries["symbol"], queries[SLICE].to_numpy(), queries["ts"].to_numpy(), entry, found, ts, close)

    keys = ["symbol", SLICE, "salt"]
    later = asked.groupBy(*keys).cogroup(ahead.select(*keys, "ts", "close", "sell").groupBy(*keys)).applyInArrow(beyond, kind)
    # Per entry the answer of each slice asked; a mark takes the one from the slice it named.
    later = later.groupBy("symbol", "ts").agg(F.map_from_entries(F.collect_list(F.struct(SLICE, "marks"))).alias("there"))
    both = wanted.join(later, ["symbol", "ts"], "left")
    marks = F.array(*(
        F.coalesce(F.get("marks", F.lit(m)), F.get(F.col("there")[F.get("next", F.lit(m))], F.lit(m))) for m in range(len(tests))
    ))
    return both.select("symbol", "ts", "close", marks.alias("marks"))
