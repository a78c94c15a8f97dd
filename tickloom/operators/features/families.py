"""The feature families, in the order later families may rely on."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.config import FeatureConfig
from tickloom.functions.numeric import flag, ratio
from tickloom.functions.rolling import previous_max, rolled, rolled_quantile
from tickloom.operators.features.family import (
    Family,
    bar_columns,
    close_lag,
    gain_and_loss,
    notional,
    simple_return,
    true_range,
    typical_price,
    volume_change,
    volume_lag,
)

def price_returns(cfg: FeatureConfig) -> Family:
    open_, high_, low_, close, _ = bar_columns()
    out = Family(lags=close_lag())
    for k in cfg.returns:
        out.lags[f"_close_{k}"] = (close, k)
        out.outputs[f"ret_{k}m"] = ratio(close, f"_close_{k}") - 1
    out.outputs.update(
        close_to_open=ratio(close - open_, open_),
        hl_range=ratio(high_ - low_, close),
        oc_abs=ratio(F.abs(open_ - close), close),
        log_ret_1m=F.ln(ratio(close, "_close_1")),
    )
    return out


def trend_momentum(cfg: FeatureConfig) -> Family:
    _, _, _, close, _ = bar_columns()
    out = Family(lags=close_lag(), derived=gain_and_loss())
    for n in cfg.ma:
        out.rolls.add(("avg", "close", n))
        out.outputs[f"ma_{n}"] = rolled("avg", "close", n)
    for n in cfg.ema:
        out.ewm[f"ema_{n}"] = ("close", 2.0 / (n + 1), n)
        out.outputs[f"ema_{n}"] = F.col(f"ema_{n}")
    for k in cfg.momentum:
        out.lags[f"_close_{k}"] = (close, k)
        out.outputs[f"momentum_{k}"] = close - F.col(f"_close_{k}")
    for n in cfg.regression:
        out.slopes[f"trend_slope_{n}"] = ("close", n)
        out.outputs[f"trend_slope_{n}"] = F.col(f"trend_slope_{n}")
    out.rolls.add(("before_max", "close", cfg.breakout))
    out.outputs["breakout_20"] = flag(close > previous_max("close", cfg.breakout))
    for n in cfg.rsi:
        if cfg.rsi_smoothing == "wilder":
            out.ewm[f"_gain_w{n}"] = ("_gain", 1.0 / n, n)
            out.ewm[f"_loss_w{n}"] = ("_loss", 1.0 / n, n)
            gain, loss = F.col(f"_gain_w{n}"), F.col(f"_loss_w{n}")
        else:
            out.rolls |= {("avg", "_gain", n), ("avg", "_loss", n)}
            gain, loss = rolled("avg", "_gain", n), rolled("avg", "_loss", n)
        out.outputs[f"rsi_{n}"] = relative_strength_index(gain, loss)
    return out


def relative_strength_index(gain: Column, loss: Column) -> Column:
    """100 without losses, NULL when nothing moved."""
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(
        100 - 100 / (1 + ratio(gain, loss))
    )


def mean_reversion(cfg: FeatureConfig) -> Family:
    _, _, _, close, _ = bar_columns()
    out = Family(derived=typical_price())
    for n in cfg.bollinger:
        out.rolls |= {("avg", "close", n), ("std", "close", n)}
        mid, spread = rolled("avg", "close", n), 2 * rolled("std", "close", n)
        out.outputs[f"bb_upper_{n}"] = mid + spread
        out.outputs[f"bb_lower_{n}"] = mid - spread
        out.outputs[f"bb_width_{n}"] = ratio(2 * spread, mid)
        out.outputs[f"bb_position_{n}"] = ratio(close - (mid - spread), 2 * spread)
    for n in cfg.stochastic:
        out.rolls |= {("min", "low", n), ("max", "high", n)}
        low, high = rolled("min", "low", n), rolled("max", "high", n)
        out.outputs[f"stoch_k_{n}"] = ratio(100 * (close - low), high - low)
        out.late_rolls.add(("avg", f"stoch_k_{n}", cfg.stochastic_smooth))
        out.late_outputs[f"stoch_d_{n}"] = rolled("avg", f"stoch_k_{n}", cfg.stochastic_smooth)
    for n in cfg.williams:
        out.rolls |= {("min", "low", n), ("max", "high", n)}
        low, high = rolled("min", "low", n), rolled("max", "high", n)
        out.outputs[f"williams_r_{n}"] = ratio(-100 * (high - close), high - low)
    for n in cfg.cci:
        out.rolls |= {("avg", "_typical", n), ("list", "_typical", n)}
        mean, items = rolled("avg", "_typical", n), rolled("list", "_typical", n)
        deviation = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / n
        out.outputs[f"cci_{n}"] = ratio(F.col("_typical") - mean, 0.015 * deviation)
    return out


def volatility_risk(cfg: FeatureConfig) -> Family:
    _, _, _, close, _ = bar_columns()
    out = Family(lags=close_lag(), derived={**simple_return(), **true_range()})
    annual = math.sqrt(cfg.bars_per_day * 365)
    for n in cfg.atr:
        out.rolls.add(("avg", "_true_range", n))
        out.outputs[f"atr_{n}"] = rolled("avg", "_true_range", n)
        out.outputs[f"atr_pct_{n}"] = ratio(rolled("avg", "_true_range", n), close)
    for n in cfg.volatility:
        out.rolls.add(("std", "_ret", n))
        out.outputs[f"volatility_{n}"] = rolled("std", "_ret", n)
        out.outputs[f"volatility_annualized_{n}"] = rolled("std", "_ret", n) * annual
    for n in cfg.var_window:
        out.rolls.add(("sorted", "_ret", n))
        out.outputs[f"var_95_{n}"] = rolled_quantile("_ret", n, 0.05)
        out.outputs[f"var_99_{n}"] = rolled_quantile("_ret", n, 0.01)
    return out


def volume_liquidity(cfg: FeatureConfig) -> Family:
    _, _, _, close, volume = bar_columns()
    out = Family(derived=notional())
    for n in cfg.volume:
        out.rolls |= {("avg", "volume", n), ("std", "volume", n)}
        out.outputs[f"volume_ma_{n}"] = rolled("avg", "volume", n)
        out.outputs[f"volume_std_{n}"] = rolled("std", "volume", n)
        out.outputs[f"volume_spike_{n}"] = flag(
            volume > cfg.volume_spike_multiplier * rolled("avg", "volume", n)
        )
    out.lags["_notional_1"] = (volume * close, 1)
    out.outputs["volume_price_trend"] = ratio("_notional", "_notional_1") - 1
    out.rolls |= {("sum", "_notional", cfg.vwap), ("sum", "volume", cfg.vwap)}
    out.outputs["volume_weighted_price"] = ratio(
        rolled("sum", "_notional", cfg.vwap), rolled("sum", "volume", cfg.vwap)
    )
    return out


def microstructure(cfg: FeatureConfig) -> Family:
    _, high_, low_, close, _ = bar_columns()
    ret = F.col("_ret")
    out = Family(lags={**close_lag(), **volume_lag()}, derived={**simple_return(), **volume_change()})
    out.outputs.update(
        bid_ask_spread=ratio(high_ - low_, close),
        # Divides by the close a second time, as published.
        spread_pct=ratio(ratio(high_ - low_, close), close),
        price_impact=ratio(F.abs(ret), "_volume_change"),
        volume_impact=ratio("_volume_change", ret),
    )
    for n in cfg.efficiency:
        out.rolls |= {("avg", "_ret", n), ("std", "_ret", n)}
        out.outputs[f"efficiency_ratio_{n}"] = ratio(rolled("avg", "_ret", n), rolled("std", "_ret", n))
    return out


def regime(cfg: FeatureConfig) -> Family:
    """Trend and liquidity flags; the volatility flag needs a second pass."""
    _, _, _, close, volume = bar_columns()
    out = Family()
    for n in cfg.trend:
        out.rolls.add(("avg", "close", n))
        mean = rolled("avg", "close", n)
        out.outputs[f"trend_up_{n}"] = flag(close > mean)
        out.outputs[f"trend_strength_{n}"] = ratio(F.abs(close - mean), mean)
    for n in cfg.liquidity:
        out.rolls.add(("avg", "volume", n))
        out.outputs[f"high_liquidity_{n}"] = flag(volume > rolled("avg", "volume", n))
    return out


def risk_execution(cfg: FeatureConfig) -> Family:
    _, _, _, close, _ = bar_columns()
    ret = F.col("_ret")
    out = Family(lags=close_lag(), derived={**simple_return(), **true_range()})
    for n in cfg.atr:
        out.rolls.add(("avg", "_true_range", n))
        distance = rolled("avg", "_true_range", n) * cfg.stop_atr_multiplier
        out.outputs[f"stop_loss_long_{n}"] = close - distance
        out.outputs[f"stop_loss_short_{n}"] = close + distance
    for n in cfg.position:
        out.rolls |= {("avg", "_ret", n), ("std", "_ret", n)}
        spread = rolled("std", "_ret", n)
        out.outputs[f"position_size_{n}"] = ratio(F.lit(1.0), spread * math.sqrt(cfg.bars_per_day))
        out.outputs[f"risk_adjusted_return_{n}"] = ratio(ret * rolled("avg", "_ret", n), spread)
    return out


def documented_extras(cfg: FeatureConfig) -> Family:
    """Features described in the documentation but absent from the default set."""
    open_, high_, low_, close, volume = bar_columns()
    ret = F.col("_ret")
    annual = math.sqrt(cfg.bars_per_day * 365)
    out = Family(
        lags={**close_lag()},
        derived={
            **simple_return(),
            **notional(),
            **true_range(),
            "_ret_down": F.when(ret < 0, ret),
        },
    )
    out.rolls |= {
        ("avg", "close", 20), ("std", "close", 20), ("avg", "volume", 20), ("std", "volume", 20),
        ("std", "_ret", 20), ("std", "_ret", 30), ("std", "_ret", 50), ("std", "_ret_down", 30),
        ("sum", "_notional", 20), ("sum", "volume", 20), ("sum", "_notional", 60),
        ("avg", "_true_range", 14),
    }
    vwap = ratio(rolled("sum", "_notional", 20), rolled("sum", "volume", 20))
    down = F.when(F.col("_count_ret_30") == 30, F.col("_std_ret_down_30"))
    out.outputs.update(
        zscore_20=ratio(close - rolled("avg", "close", 20), rolled("std", "close", 20)),
        bb_bandwidth_20=ratio(4 * rolled("std", "close", 20), rolled("avg", "close", 20)),
        vwap_dist=ratio(close, vwap) - 1,
        vol_20=rolled("std", "_ret", 20) * annual,
        vol_50=rolled("std", "_ret", 50) * annual,
        realized_vol_30=rolled("std", "_ret", 30) * annual,
        downside_vol_30=down * annual,
        vol_zscore_20=ratio(volume - rolled("avg", "volume", 20), rolled("std", "volume", 20)),
        notional_volume=F.col("_notional"),
        notional_share_60=ratio("_notional", rolled("sum", "_notional", 60)),
        hl_spread=ratio(high_ - low_, close),
        oc_spread=ratio(F.abs(open_ - close), close),
        kyle_lambda_proxy=ratio(F.abs(ret), "_notional"),
        stop_distance_hint=2 * rolled("avg", "_true_range", 14),
    )
    out.late_rolls.add(("autocov", "_ret", 20))
    out.late_outputs["roll_measure_proxy"] = F.when(
        F.col("_count_ret_20") == 20, F.col("_autocov_ret_20")
    )
    return out


FAMILIES = {
    "price_returns": price_returns,
    "trend_momentum": trend_momentum,
    "mean_reversion": mean_reversion,
    "volatility_risk": volatility_risk,
    "volume_liquidity": volume_liquidity,
    "microstructure": microstructure,
    "regime": regime,
    "risk_execution": risk_execution,
}
