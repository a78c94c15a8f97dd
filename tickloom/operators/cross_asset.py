"""Features relating each symbol to a driver symbol at the same instant, or as of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.functions.rolling import add_long_windows, add_rolls, is_long, rolled
from tickloom.plans.scan import running
from tickloom.plans.slices import BORROWED, SLICE, slice_series


def _returns(bars: DataFrame, rows_per_slice: int | None) -> DataFrame:
    series = slice_series(bars, ["symbol"], ["ts"], lookback=1, rows_per_slice=rows_per_slice)
    ret = ratio("close", F.lag("close", 1).over(series.window)) - 1
    return series.owned(series.df.withColumn("ret", ret))


def align_to_driver(
    bars: DataFrame,
    driver: str,
    symbols: list[str] | None = None,
    *,
    tolerance: str | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Each bar next to the driver's: of the same ``ts`` or, with ``tolerance``, the last at or before it.

    The exact form is an equi-join on ``ts``, which spreads evenly whatever the symbol mix, because
    ``(symbol, ts)`` is unique; the driver side is one row per instant and is
    left to the optimizer to broadcast or shuffle.

    The as-of form walks the bars of all symbols as one series in time, cut into slices, and carries the driver's
    last known bar along; ``driver_ts`` says which one it is. A bar whose driver bar is older than
    ``tolerance`` (an interval such as ``5 minutes``), or that has none, is left out.
    """
    rows = _returns(bars, rows_per_slice)
    others = rows.where(F.col("symbol") != driver)
    if symbols is not None:
        others = others.where(F.col("symbol").isin(symbols))
    if tolerance is None:
        lead = rows.where(F.col("symbol") == driver).select(
            "ts", F.col("close").alias("close_driver"), F.col("ret").alias("ret_driver")
        )
        return others.select("symbol", "ts", "close", "ret").join(lead, "ts")
    wanted = F.col("symbol").isin(symbols) if symbols is not None else F.lit(True)
    is_driver = F.col("symbol") == driver
    bar = F.when(is_driver, F.struct(F.col("ts").alias("ts"), F.col("close").alias("close"), F.col("ret").alias("ret")))
    walk = rows.where(is_driver | wanted).select("symbol", "ts", "close", "ret", (~is_driver).cast("int").alias("_after"), F.lit(0).alias("_all"))
    # The driver's own bar of an instant comes first.
    known = running(walk, ["_all"], ["ts", "_after"], {"_driver": ("last", bar)}, rows_per_slice=rows_per_slice)
    fresh = F.col("_driver.ts") >= F.col("ts") - F.expr(f"INTERVAL {tolerance}")
    return known.where((F.col("_after") == 1) & fresh).select(
        "ts", "symbol", "close", "ret", F.col("_driver.close").alias("close_driver"), F.col("_driver.ret").alias("ret_driver"), F.col("_driver.ts").alias("driver_ts")
    )


def driver_features(
    bars: DataFrame, driver: str, window: int = 720, *, tolerance: str | None = None, rows_per_slice: int | None = None
) -> DataFrame:
    """``beta_to_driver_<n>``: Cov(r, r_driver) / Var(r_driver) over ``n`` aligned bars.

    Long windows are assembled from blocks, so no row reads a frame of ``n`` others. ``tolerance`` aligns as of
    each bar (see :func:`align_to_driver`).
    """
    joined = align_to_driver(bars, driver, tolerance=tolerance, rows_per_slice=rows_per_slice)
    both = F.col("ret").isNotNull() & F.col("ret_driver").isNotNull()
    series = slice_series(
        joined.withColumns({"_x": F.when(both, F.col("ret")), "_y": F.when(both, F.col("ret_driver"))}),
        ["symbol"], ["ts"], lookback=window, rows_per_slice=rows_per_slice,
    )
    if is_long(("std", "_y", window)):
        spread = ("std", "_y", window)
        parts = add_long_windows(series.df, series.window, {}, {}, [spread], pairs={"_cov": ("_x", "_y", window)})
        beta = ratio("_cov", rolled(*spread) * rolled(*spread))
    else:
        frame = series.window.rowsBetween(-(window - 1), 0)
        parts = series.df.withColumns(
            {"_n": F.count("_x").over(frame), "_cov": F.covar_samp("_x", "_y").over(frame), "_var": F.var_samp("_y").over(frame)}
        )
        beta = F.when(F.col("_n") == window, ratio("_cov", "_var"))
    kept = [*joined.columns, f"beta_to_driver_{window}", *([SLICE, BORROWED] if series.sliced else [])]
    return series.owned(parts.withColumn(f"beta_to_driver_{window}", beta).select(*kept))


def pair_features(
    bars: DataFrame, symbol: str, driver: str, window: int = 240, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Close ratio of a pair, its rolling z-score and the return difference."""
    pair = align_to_driver(bars, driver, [symbol], rows_per_slice=rows_per_slice).withColumns(
        {"ratio": ratio("close", "close_driver"), "return_diff": F.col("ret") - F.col("ret_driver")}
    )
    series = slice_series(pair, ["symbol"], ["ts"], lookback=window, rows_per_slice=rows_per_slice)
    rolls = [("avg", "ratio", window), ("std", "ratio", window)]
    if is_long(rolls[0]):
        numbered = series.df.withColumn("_row", F.row_number().over(series.window))
        parts = add_long_windows(numbered, series.window, {}, {}, rolls)
    else:
        parts = add_rolls(series.df, series.window, rolls)
    score = ratio(F.col("ratio") - rolled("avg", "ratio", window), rolled("std", "ratio", window))
    kept = [*pair.columns, "ratio_zscore", *([SLICE, BORROWED] if series.sliced else [])]
    return series.owned(parts.withColumn("ratio_zscore", score).select(*kept))
