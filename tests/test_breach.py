"""Breaches at any distance: the block search, slices, and short keys beside a long one."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from conftest import collect
from tickloom.config import TradeConfig
from tickloom.operators import feature_qc as fq
from tickloom.operators.trades import barrier_outcomes, first_round_trip
from tickloom.plans.breach import first_at_or_below
from tickloom.plans.slices import slice_series
from tickloom.streaming.jobs import stored_sessions, trading_sessions


def test_block_search_equals_a_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 63, 64, 65, 500, 5000):
        values = np.cumsum(rng.normal(size=n)) if n else np.zeros(0)
        start, level = rng.integers(0, n + 1, 300), rng.normal(size=300) * np.sqrt(n + 1)
        want = [next((j for j in range(s, n) if values[j] <= x), n) for s, x in zip(start, level)]
        assert first_at_or_below(values, start, level).tolist() == want


def test_far_exit_is_found_whole_and_sliced(spark):
    base = datetime(2025, 1, 1)
    rows = [("A", base + timedelta(minutes=i), 100.0 if i < 180 else 90.0, "buy" if i in (0, 7) else "hold") for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, signal string")
    cfg = TradeConfig()
    for size in (None, 20):
        got = collect(barrier_outcomes(df, cfg, rows_per_slice=size), "entry_time")
        assert got["exit_reason"].tolist() == ["stop_loss"] * 2
        assert got["exit_time"].tolist() == [base + timedelta(minutes=180)] * 2
    assert first_round_trip(df, cfg).first()["exit_reason"] == "stop_loss"


def test_only_long_keys_are_cut(spark):
    long = spark.range(1000).select(F.lit(-1).cast("long").alias("k"), F.col("id").alias("t"))
    short = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("t"))
    series = slice_series(long.unionByName(short), ["k"], ["t"], lookback=1, rows_per_slice=100)
    assert series.sliced
    assert series.owned(series.df).count() == 3000
    assert series.df.where("k >= 0 AND _slice <> 0").isEmpty()
    assert series.df.where("k = -1").select("_slice").distinct().count() > 5


def test_stored_sessions_equal_session_windows(spark):
    ticks = spark.range(1500).select(
        F.when(F.col("id") < 1200, "hot").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("symbol"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10_000_000))).alias("ts"),
    )
    rows = lambda df: sorted(map(tuple, df.select("symbol", "session_start", "session_end", "ticks").collect()))
    want = rows(trading_sessions(ticks))
    assert rows(stored_sessions(ticks)) == want
    assert rows(stored_sessions(ticks, rows_per_slice=60)) == want


def test_non_finite_cells_are_missing(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (nan, 8.0), (4.0, inf)], "a double, b double")
    row = {r["feature"]: r for r in fq.describe(df, ["a", "b"]).collect()}
    assert (row["a"]["count"], row["a"]["max"], row["a"]["p50"]) == (4, 4.0, 2.5)
    assert (row["b"]["count"], row["b"]["mean"]) == (4, 5.0)
    assert {r["feature"]: (r["nan_count"], r["inf_count"]) for r in fq.missing_counts(df, ["a", "b"]).collect()} == {"a": (1, 0), "b": (0, 1)}
    pair = fq.correlation_pairs(df, ["a", "b"]).first()
    assert pair["n"] == 3 and abs(pair["correlation"] - 1.0) < 1e-12
