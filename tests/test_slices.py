"""Sliced plans give exactly what whole-series plans give."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import assert_close, collect, walk
from tickloom.config import FeatureConfig, TradeConfig
from tickloom.operators.cross_asset import driver_features, pair_features
from tickloom.operators.features import compute_features, volatility_percentile
from tickloom.operators.performance import (
    performance_summary, with_cumulative_return, with_drawdown, with_returns, with_rolling_risk,
)
from tickloom.operators.quality import gaps, price_jumps
from tickloom.operators.signals import label_signals
from tickloom.operators.trades import barrier_outcomes, equity_curve, grid_rank, open_positions_ordered
from tickloom.plans.quantiles import quantiles
from tickloom.plans.ranks import above_so_far, prefix_rank
from tickloom.plans.scan import running
from tickloom.plans.slices import SLICE, slice_series

SMALL = FeatureConfig(regression=(20, 60), ema=(5,), ma=(20, 50))
SIGNAL_CFG = FeatureConfig(ma=(20, 50), ema=(), regression=(), momentum=())


def test_slices_cover_every_row_once_and_stay_small(walk_bars):
    series = slice_series(walk_bars, ["symbol"], ["ts"], lookback=30, rows_per_slice=100)
    assert series.sliced
    owned = series.df.where("NOT _borrowed")
    assert owned.count() == walk_bars.count()
    assert owned.select("symbol", "ts").distinct().count() == walk_bars.count()
    sizes = owned.groupBy("symbol", SLICE).count().toPandas()
    assert sizes["count"].max() < 300 and len(sizes) > 10


def test_slices_borrow_the_rows_before(walk_bars):
    series = slice_series(walk_bars, ["symbol"], ["ts"], lookback=30, rows_per_slice=100)
    pdf = series.df.select("symbol", SLICE, "_borrowed", "ts").toPandas()
    for (symbol, s), part in pdf.groupby(["symbol", SLICE]):
        first = part.loc[~part["_borrowed"], "ts"].min()
        available = int((first - pd.Timestamp("2024-01-01")).total_seconds() // 60)
        before = part.loc[part["ts"] < first, "ts"]
        assert len(before) >= min(30, available), (symbol, s)
        # Minute bars without holes: the borrowed rows are the latest ones.
        assert len(before) == 0 or (first - before.min()) == pd.Timedelta(minutes=len(before))


@pytest.mark.parametrize(
    "families",
    [["price_returns", "trend_momentum"], ["mean_reversion", "volatility_risk", "regime"], ["volume_liquidity", "extras"]],
)
def test_features_sliced_equal_whole(walk_bars, families):
    whole = compute_features(walk_bars, SMALL, families)
    sliced = compute_features(walk_bars, SMALL, families, rows_per_slice=150)
    assert_close(collect(whole, "symbol", "ts"), collect(sliced, "symbol", "ts"), 1e-8)


def test_sparse_series_borrow_across_many_slices(spark):
    # Bursts and long holes: look-back reaches over several slices.
    rng = np.random.default_rng(5)
    minutes = np.unique(np.concatenate([rng.integers(0, 300, 120), rng.integers(50_000, 50_100, 60), rng.integers(90_000, 200_000, 40)]))
    pdf = pd.DataFrame({"symbol": "S", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "min"), "close": rng.normal(100, 1, len(minutes))})
    for c in ("open", "high", "low"):
        pdf[c] = pdf["close"]
    pdf["volume"] = 1.0
    bars = spark.createDataFrame(pdf)
    cfg = FeatureConfig(ma=(40,), ema=(), regression=(45,), momentum=(), rsi=())
    whole = compute_features(bars, cfg, ["trend_momentum"])
    sliced = compute_features(bars, cfg, ["trend_momentum"], rows_per_slice=10)
    assert_close(collect(whole, "ts"), collect(sliced, "ts"))


def test_lookahead_sliced_equal_whole(walk_bars):
    labelled = label_signals(compute_features(walk_bars, SIGNAL_CFG, ["trend_momentum"])).cache()
    cfg = TradeConfig(stop_loss_pct=0.002, take_profit_pct=0.003)
    whole = barrier_outcomes(labelled, cfg)
    sliced = barrier_outcomes(labelled, cfg, rows_per_slice=80)
    assert_close(collect(whole, "symbol", "entry_time"), collect(sliced, "symbol", "entry_time"))
    keys = ["stop_loss_pct", "take_profit_pct", "max_position_size"]
    assert_close(collect(grid_rank(labelled, cfg=cfg), *keys), collect(grid_rank(labelled, cfg=cfg, rows_per_slice=80), *keys))


def test_running_matches_pandas(spark, walk_bars, walk_pdf):
    measures = {
        "total": ("sum", F.col("volume")), "top": ("max", F.col("close")),
        "low_": ("min", F.col("close")), "n": ("count", F.col("close")),
    }
    expected = walk_pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = expected.groupby("symbol")
    expected["total"], expected["top"] = g["volume"].cumsum(), g["close"].cummax()
    expected["low_"], expected["n"] = g["close"].cummin(), g.cumcount() + 1
    for rows in (None, 70):
        out = running(walk_bars, ["symbol"], ["ts"], measures, rows_per_slice=rows)
        assert_close(collect(out, "symbol", "ts"), expected)


def test_other_operators_sliced_equal_whole(walk_bars):
    pick = walk_bars.where("symbol <> 'CCC'")
    pairs = [
        (lambda r: driver_features(pick, "AAA", 50, rows_per_slice=r), ("symbol", "ts")),
        (lambda r: pair_features(pick, "BBB", "AAA", 40, rows_per_slice=r), ("ts",)),
        (lambda r: gaps(walk_bars.where(F.minute("ts") % 7 != 0), rows_per_slice=r), ("symbol", "gap_end")),
        (lambda r: price_jumps(walk_bars, rows_per_slice=r), ("symbol", "ts")),
        (lambda r: volatility_percentile(walk_bars, 100, rows_per_slice=r), ("symbol", "ts")),
    ]
    for build, keys in pairs:
        assert_close(collect(build(None), *keys), collect(build(60), *keys))


def test_performance_sliced_equal_whole(walk_bars):
    equity = walk_bars.select("symbol", F.col("ts").alias("timestamp"), F.col("close").alias("portfolio_value"))
    keys = ["symbol"]
    def everything(rows):
        df = with_returns(equity, keys, rows_per_slice=rows)
        df = with_cumulative_return(df, keys, rows_per_slice=rows)
        df = with_drawdown(df, keys, rows_per_slice=rows)
        return with_rolling_risk(df, keys, rows_per_slice=rows)
    assert_close(collect(everything(None), "symbol", "timestamp"), collect(everything(90), "symbol", "timestamp"))
    assert_close(
        collect(performance_summary(equity, keys), "symbol"),
        collect(performance_summary(equity, keys, rows_per_slice=90), "symbol"),
    )


def test_equity_and_positions_sliced_equal_whole(spark, walk_bars):
    legs = walk_bars.where(F.minute("ts") % 3 == 0).select(
        "symbol", "ts", F.when(F.minute("ts") % 2 == 0, "buy").otherwise("sell").alias("action"),
        F.lit(2.0).alias("quantity"), F.lit(-1.0).alias("cash_flow"),
    )
    assert_close(
        collect(equity_curve(walk_bars, legs), "timestamp"),
        collect(equity_curve(walk_bars, legs, rows_per_slice=50), "timestamp"),
    )
    assert_close(
        collect(open_positions_ordered(legs), "symbol"),
        collect(open_positions_ordered(legs, rows_per_slice=50), "symbol"),
    )


def test_prefix_rank_counts_smaller_earlier_values(spark):
    rng = np.random.default_rng(3)
    n = 400
    # Half of the values are equal.
    values = np.where(rng.random(n) < 0.5, 0.0, rng.normal(0, 1, n))
    pdf = pd.DataFrame({"k": np.where(np.arange(n) < 320, "a", "b"), "t": np.arange(n), "v": values})
    want = pdf.copy()
    want["below"] = [int(((pdf["k"] == r.k) & (pdf["t"] < r.t) & (pdf["v"] < r.v)).sum()) for r in pdf.itertuples()]
    want["seen"] = pdf.groupby("k").cumcount() + 1
    for rows in (None, 40):
        got = prefix_rank(spark.createDataFrame(pdf), ["k"], "t", "v", rows_per_slice=rows)
        assert_close(collect(got, "t"), want)


def test_bracketed_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(11)
    frames = [
        pd.DataFrame({"k": "a", "v": rng.normal(0, 1, 6000)}),
        # Two thirds of one group share a value.
        pd.DataFrame({"k": "b", "v": np.concatenate([np.zeros(2000), rng.normal(0, 1, 1000)])}),
        pd.DataFrame({"k": "c", "v": [3.0]}),
    ]
    df = spark.createDataFrame(pd.concat(frames, ignore_index=True)).unionByName(
        spark.createDataFrame([("a", None)], "k string, v double")
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    exact = quantiles(df, ["k"], "v", probs)
    bracketed = quantiles(df, ["k"], "v", probs, max_group_rows=0, accuracy=100)
    left, right = collect(exact, "k"), collect(bracketed, "k")
    assert left["k"].tolist() == right["k"].tolist()
    for x, y in zip(left["quantiles"], right["quantiles"]):
        np.testing.assert_allclose(x, y, atol=1e-12)


def test_above_so_far_decides_block_by_block(spark):
    """Blocks, ties of values and instants, a drift, NaN, nulls and a short series, against sorted prefixes."""
    rng = np.random.default_rng(8)
    rows = []
    for k, n in (("a", 900), ("b", 7), ("c", 130)):
        at = np.sort(rng.integers(0, 4 * n, n)) if k == "a" else np.arange(n)
        x = rng.normal(size=n) + np.arange(n) / 300
        x[rng.random(n) < 0.3] = 0.25
        y = np.round(rng.normal(size=n), 1)
        rows += [(k, int(t), float("nan") if i % 97 == 5 else float(v), None if i % 11 == 3 else float(w)) for i, (t, v, w) in enumerate(zip(at, x, y))]
        rows.append((k, None, 1.0, 2.0))
    want = []
    for k in "abc":
        for c in (2, 3):
            own = sorted((r for r in rows if r[0] == k and r[1] is not None and r[c] is not None), key=lambda r: (r[1], -np.inf if np.isnan(r[c]) else r[c]))
            for i, r in enumerate(own):
                below = sum(s[c] < r[c] for s in own[:i])
                want.append((k, r[1], c, bool(below > (i + 1) * 0.8 + 1e-9)))
    frame = spark.createDataFrame(rows, "k string, t long, x double, y double")
    for size in (40, 5000):
        flags, repeated = above_so_far(frame, "k", "t", ["x", "y"], 0.8, rows_per_block=size)
        got = [(r["k"], r["t"], c, r["xy"[c - 2]]) for r in flags.collect() for c in (2, 3) if r["xy"[c - 2]] is not None]
        assert sorted(got) == sorted(want) and repeated
    assert "Scan ExistingRDD" not in flags._jdf.queryExecution().toString()
    assert not above_so_far(frame.where("k = 'c'"), "k", "t", ["x"], 0.8)[1]


def test_expanding_flags_rank_all_columns_from_one_stored_table(spark):
    bars = spark.createDataFrame(walk("A", 300, 5))
    flagged = compute_features(bars, FeatureConfig(volatility_mode="expanding"), ["volatility_risk", "regime"]).select("symbol", "ts", "high_volatility_20", "high_volatility_50")
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan
