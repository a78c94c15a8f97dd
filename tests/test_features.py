"""Feature values against pandas, warm-up, stability under new rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, assert_close, collect, walk
from tickloom.config import FeatureConfig, config_hash
from tickloom.operators.features import compute_features, feature_names, winsorize, with_metadata
from datetime import datetime

ANNUAL = np.sqrt(1440 * 365)


def golden(pdf: pd.DataFrame) -> pd.DataFrame:
    """Expected features of one symbol's ordered bars."""
    o, h, l, c, v = (pdf[x].reset_index(drop=True) for x in ("open", "high", "low", "close", "volume"))
    ret, dv = c / c.shift(1) - 1, v / v.shift(1) - 1
    out: dict[str, pd.Series] = {f"ret_{k}m": c / c.shift(k) - 1 for k in (1, 5, 15)}
    out |= {"close_to_open": (c - o) / o, "hl_range": (h - l) / c, "oc_abs": (o - c).abs() / c, "log_ret_1m": np.log(c / c.shift(1))}
    out |= {f"ma_{n}": c.rolling(n).mean() for n in (20, 50, 100)}
    out |= {f"ema_{n}": c.ewm(span=n, adjust=True, min_periods=n).mean() for n in (20, 50)}
    out |= {f"momentum_{k}": c - c.shift(k) for k in (10, 20)}
    for n in (20, 240, 720):
        x = np.arange(n) - (n - 1) / 2
        out[f"trend_slope_{n}"] = c.rolling(n).apply(lambda w: (x * w).sum() / (x * x).sum(), raw=True)
    out["breakout_20"] = (c > c.rolling(20).max().shift(1)).astype(int)
    gain, loss = c.diff().clip(lower=0).fillna(0), (-c.diff()).clip(lower=0).fillna(0)
    rs = gain.rolling(14).mean() / loss.rolling(14).mean()
    out["rsi_14"] = 100 - 100 / (1 + rs)
    mid, sd = c.rolling(20).mean(), c.rolling(20).std()
    out |= {"bb_upper_20": mid + 2 * sd, "bb_lower_20": mid - 2 * sd, "bb_width_20": 4 * sd / mid, "bb_position_20": (c - mid + 2 * sd) / (4 * sd)}
    ll, hh = l.rolling(14).min(), h.rolling(14).max()
    k = 100 * (c - ll) / (hh - ll)
    out |= {"stoch_k_14": k, "stoch_d_14": k.rolling(3).mean(), "williams_r_14": -100 * (hh - c) / (hh - ll)}
    tp = (h + l + c) / 3
    mad = tp.rolling(20).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)
    out["cci_20"] = (tp - tp.rolling(20).mean()) / (0.015 * mad)
    tr = pd.concat([h - l, (h - c.shift(1)).abs(), (l - c.shift(1)).abs()], axis=1).max(axis=1)
    tr.iloc[0] = np.nan
    atr = tr.rolling(14).mean()
    out |= {"atr_14": atr, "atr_pct_14": atr / c}
    for n in (20, 50):
        out[f"volatility_{n}"] = ret.rolling(n).std()
        out[f"volatility_annualized_{n}"] = ret.rolling(n).std() * ANNUAL
        out[f"volume_ma_{n}"], out[f"volume_std_{n}"] = v.rolling(n).mean(), v.rolling(n).std()
        out[f"volume_spike_{n}"] = (v > 2 * v.rolling(n).mean()).astype(int)
        ma = c.rolling(n).mean()
        out[f"trend_up_{n}"], out[f"trend_strength_{n}"] = (c > ma).astype(int), (c - ma).abs() / ma
        vol = ret.rolling(n).std()
        out[f"high_volatility_{n}"] = (vol > vol.quantile(0.8)).astype(int)
    out |= {"var_95_20": ret.rolling(20).quantile(0.05), "var_99_20": ret.rolling(20).quantile(0.01)}
    out["volume_price_trend"] = (v * c) / (v * c).shift(1) - 1
    out["volume_weighted_price"] = (v * c).rolling(20).sum() / v.rolling(20).sum()
    out |= {"bid_ask_spread": (h - l) / c, "spread_pct": (h - l) / c / c, "price_impact": ret.abs() / dv, "volume_impact": dv / ret}
    m, s = ret.rolling(20).mean(), ret.rolling(20).std()
    out |= {"efficiency_ratio_20": m / s, "position_size_20": 1 / (s * np.sqrt(1440)), "risk_adjusted_return_20": ret * m / s}
    out["high_liquidity_20"] = (v > v.rolling(20).mean()).astype(int)
    out |= {"stop_loss_long_14": c - 2 * atr, "stop_loss_short_14": c + 2 * atr}
    return pd.DataFrame(out)


@pytest.fixture(scope="module")
def features(walk_bars):
    return collect(compute_features(walk_bars), "symbol", "ts")


def test_all_features_match_pandas(features, walk_pdf):
    parts = [golden(walk_pdf[walk_pdf["symbol"] == s].sort_values("ts")) for s in ("AAA", "BBB", "CCC")]
    expected = pd.concat(parts, ignore_index=True)
    assert sorted(expected.columns) == sorted(feature_names())
    assert_close(features[list(expected.columns)], expected, 1e-8)


def test_shipped_set_has_59_features_and_metadata(walk_bars):
    assert len(feature_names()) == 59
    out = with_metadata(compute_features(walk_bars), FeatureConfig(), datetime(2024, 1, 1))
    row = out.select("feature_computed_at", "feature_version", "config_hash").first()
    assert row["config_hash"] == config_hash(FeatureConfig()) and len(row["config_hash"]) == 16
    assert config_hash({"b": 1, "a": 2}) == config_hash({"a": 2, "b": 1})


def test_warm_up_nulls(features):
    aaa = features[features["symbol"] == "AAA"]
    for name, nulls in {
        "ret_1m": 1, "ma_20": 19, "ema_20": 19, "rsi_14": 13, "trend_slope_720": 719, "breakout_20": 0, "atr_14": 14,
    }.items():
        assert aaa[name].isna().sum() == nulls, name
    assert aaa["rsi_14"].dropna().between(0, 100).all()


def test_no_look_ahead(spark, walk_pdf, features):
    """Features of a prefix equal the prefix of the features (volatility flag excepted)."""
    prefix = walk_pdf[walk_pdf["ts"] < "2024-01-01 06:00"]
    got = collect(compute_features(spark.createDataFrame(prefix, BAR_SCHEMA)), "symbol", "ts")
    want = features[features["ts"] < "2024-01-01 06:00"].reset_index(drop=True)
    steady = [c for c in got.columns if not c.startswith("high_volatility")]
    assert_close(got[steady], want[steady])


def test_single_row_empty_and_flat_series(spark, walk_pdf):
    one = compute_features(spark.createDataFrame(walk_pdf.head(1), BAR_SCHEMA))
    assert one.count() == 1
    assert compute_features(spark.createDataFrame([], BAR_SCHEMA)).count() == 0
    flat = walk("F", 60, 1)
    for c in ("open", "high", "low", "close"):
        flat[c] = 10.0
    out = collect(compute_features(spark.createDataFrame(flat, BAR_SCHEMA)), "ts")
    for c in ("rsi_14", "bb_position_20", "stoch_k_14", "cci_20", "efficiency_ratio_20"):
        assert out[c].isna().all(), c
    assert (out["volatility_20"].dropna() == 0).all() and (out["trend_slope_20"].dropna() == 0).all()


def test_rsi_is_100_without_losses(spark):
    up = walk("U", 40, 1)
    up["close"] = np.arange(40) + 1.0
    out = collect(compute_features(spark.createDataFrame(up, BAR_SCHEMA), families=["trend_momentum"]), "ts")
    assert out["rsi_14"].dropna().eq(100.0).all()


def test_wilder_smoothing(spark, walk_pdf):
    one = walk_pdf[walk_pdf["symbol"] == "BBB"].sort_values("ts").reset_index(drop=True)
    cfg = FeatureConfig(rsi_smoothing="wilder")
    out = collect(compute_features(spark.createDataFrame(one, BAR_SCHEMA), cfg, ["trend_momentum"]), "ts")
    d = one["close"].diff()
    gain, loss = d.clip(lower=0).fillna(0), (-d).clip(lower=0).fillna(0)
    ew = lambda x: x.ewm(alpha=1 / 14, adjust=True, min_periods=14).mean()
    expected = 100 - 100 / (1 + ew(gain) / ew(loss))
    np.testing.assert_allclose(out["rsi_14"], expected, rtol=1e-8)


def test_nulls_inside_a_window_give_null(spark, walk_pdf):
    one = walk_pdf[walk_pdf["symbol"] == "BBB"].sort_values("ts").reset_index(drop=True)
    one.loc[200, "volume"] = np.nan
    df = spark.createDataFrame(one, BAR_SCHEMA).withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    out = collect(compute_features(df, families=["volume_liquidity"]), "ts")
    v = one["volume"]
    for n in (20, 50):
        np.testing.assert_allclose(out[f"volume_ma_{n}"], v.rolling(n).mean(), rtol=1e-9)
        np.testing.assert_allclose(out[f"volume_std_{n}"], v.rolling(n).std(), rtol=1e-9)


def test_winsorize_clips_to_symbol_quantiles(walk_bars, features):
    out = collect(winsorize(compute_features(walk_bars, families=["price_returns"]), ["ret_1m"], 0.05), "symbol", "ts")
    for symbol, part in features.groupby("symbol"):
        low, high = part["ret_1m"].quantile([0.05, 0.95])
        got = out[out["symbol"] == symbol]["ret_1m"].to_numpy()
        np.testing.assert_allclose(got, part["ret_1m"].clip(low, high), rtol=1e-9)


def test_plan_has_one_shuffle_and_one_sort(walk_bars):
    families = ["price_returns", "trend_momentum", "mean_reversion", "volatility_risk", "volume_liquidity", "microstructure", "risk_execution"]
    plan = compute_features(walk_bars, families=families)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_unused_features_are_pruned(walk_bars):
    plan = compute_features(walk_bars).select("symbol", "ts", "ret_1m")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "stddev" not in plan
