"""Rule-based signals, their summaries, risk metrics and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import SignalRules
from tickloom.functions.numeric import clip, count_if, ratio

# Fixed enumerations.
SIGNAL_TYPES = (
    "BUY", "SELL", "HOLD", "CLOSE", "SCALP", "SWING", "POSITION_SIZE", "STOP_LOSS", "TAKE_PROFIT",
)
SIGNAL_STRENGTHS = ("WEAK", "MODERATE", "STRONG", "EXTREME")
SIGNAL_SOURCES = (
    "TECHNICAL_INDICATOR", "PATTERN_RECOGNITION", "MACHINE_LEARNING", "FUNDAMENTAL", "SENTIMENT",
    "REGIME_DETECTION", "RISK_MANAGEMENT", "PORTFOLIO_OPTIMIZATION",
)
STRATEGIES = ("momentum", "rsi_extreme", "trend", "breakout", "rsi_shift")


def label_signals(features: DataFrame, rules: SignalRules | None = None) -> DataFrame:
    """Add ``signal`` (buy/sell/hold) and the ``strategy`` that fired first."""
    r = rules or SignalRules()
    close, fast, slow, rsi = (F.col(c) for c in ("close", "ma_20", "ma_50", "rsi_14"))
    ordered = [
        ("momentum", "buy", (close > fast * r.momentum_up) & (rsi < r.momentum_rsi_max)),
        ("momentum", "sell", (close < fast * r.momentum_down) & (rsi > r.momentum_rsi_min)),
        ("rsi_extreme", "buy", rsi < r.rsi_low),
        ("rsi_extreme", "sell", rsi > r.rsi_high),
        ("trend", "buy", (fast > slow) & (close > fast * r.trend_up)),
        ("trend", "sell", (fast < slow) & (close < fast * r.trend_down)),
        ("breakout", "buy", close > fast * r.breakout_up),
        ("breakout", "sell", close < fast * r.breakout_down),
        ("rsi_shift", "buy", rsi.between(*r.shift_buy) & (close > fast * r.shift_buy_ratio)),
        ("rsi_shift", "sell", rsi.between(*r.shift_sell) & (close < fast * r.shift_sell_ratio)),
    ]
    known = fast.isNotNull() & slow.isNotNull() & rsi.isNotNull()
    signal = F.when(~known, "hold")
    strategy = F.when(~known, F.lit(None).cast("string"))
    for name, side, fires in ordered:
        signal = signal.when(fires, side)
        strategy = strategy.when(fires, name)
    return features.withColumns({"signal": signal.otherwise("hold"), "strategy": strategy})


def signal_mix(labelled: DataFrame, by: Sequence[str | Column] = ("symbol",)) -> DataFrame:
    """Counts of each signal and strategy per group."""
    return labelled.groupBy(*by, "signal", "strategy").agg(F.count("*").alias("n"))


def signal_id(symbol: str = "symbol", kind: str = "signal_type", ts: str = "ts") -> Column:
    return F.concat_ws("_", symbol, kind, F.date_format(ts, "yyyyMMdd_HHmmss"))


def filter_signals(
    signals: DataFrame,
    *,
    kinds: Sequence[str] | None = None,
    symbols: Sequence[str] | None = None,
    strengths: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Keep signals matching every given criterion."""
    chosen = {
        "signal_type": kinds, "symbol": symbols, "signal_strength": strengths, "signal_source": sources,
    }
    for name, values in chosen.items():
        if values is not None:
            signals = signals.where(F.col(name).isin(list(values)))
    if min_confidence is not None:
        signals = signals.where(F.col("confidence_score") >= min_confidence)
    return signals


def enum_counts(signals: DataFrame, column: str, members: Sequence[str]) -> DataFrame:
    """``member, n`` for every enumeration member, zero where absent."""
    everyone = signals.sparkSession.createDataFrame([(m,) for m in members], "member string")
    counts = signals.groupBy(F.col(column).alias("member")).agg(F.count("*").alias("n"))
    return everyone.join(counts, "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def signal_summary(signals: DataFrame) -> DataFrame:
    """Totals, a count column per enum member, confidence moments, symbols, dates."""
    per_enum = [
        count_if(F.col(column) == member).alias(f"n_{member.lower()}")
        for column, members in (
            ("signal_type", SIGNAL_TYPES), ("signal_strength", SIGNAL_STRENGTHS), ("signal_source", SIGNAL_SOURCES),
        )
        for member in members
    ]
    return signals.agg(
        F.count("*").alias("total_signals"),
        *per_enum,
        F.avg("confidence_score").alias("confidence_mean"),
        F.stddev_pop("confidence_score").alias("confidence_std"),
        F.min("confidence_score").alias("confidence_min"),
        F.max("confidence_score").alias("confidence_max"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("ts").alias("first_signal"),
        F.max("ts").alias("last_signal"),
    )


def confidence(weights: Mapping[str, float], base: float = 0.5, values: str | None = None) -> Column:
    """Mean of ``base`` and the weighted mean of the available features, in [0, 1].

    Features are columns, or entries of the map column ``values``.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        value = F.col(name) if values is None else F.try_element_at(values, F.lit(name))
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(float(w))).otherwise(0.0)
    mixed = clip((F.lit(base) + ratio(total, weight)) / 2, F.lit(0.0), F.lit(1.0))
    return F.coalesce(mixed, F.lit(base))


def with_risk_metrics(signals: DataFrame) -> DataFrame:
    """Risk and reward per share, as a fraction, and their ratio.

    A zero price is missing; a risk below a billionth is rounding, so it has no ratio.
    """
    entry, stop, target = (F.nullif(F.col(c), F.lit(0.0)) for c in ("entry_price", "stop_loss", "take_profit"))
    risk, reward = F.abs(entry - stop), F.abs(target - entry)
    return signals.withColumns(
        {
            "risk_per_share": risk,
            "risk_pct": ratio(risk, entry),
            "reward_per_share": reward,
            "reward_pct": ratio(reward, entry),
            "risk_reward_ratio": F.when(risk > 1e-9, ratio(reward, risk)),
        }
    )


def with_validation(signals: DataFrame) -> DataFrame:
    """Add ``errors`` and ``warnings`` arrays and the ``valid`` flag."""
    kind, entry = F.col("signal_type"), F.col("entry_price")
    stop, target = F.col("stop_loss"), F.col("take_profit")
    directional = kind.isin("BUY", "SELL")
    both = (stop != 0) & (target != 0)
    buy, sell = both & (kind == "BUY"), both & (kind == "SELL")
    confidence_score = F.col("confidence_score")
    errors = [
        F.when(directional & entry.isNull(), "Entry price required for BUY/SELL signals"),
        F.when(buy & (stop >= entry), "Stop loss must be below entry price for BUY signals"),
        F.when(buy & (target <= entry), "Take profit must be above entry price for BUY signals"),
        F.when(sell & (stop <= entry), "Stop loss must be above entry price for SELL signals"),
        F.when(sell & (target >= entry), "Take profit must be below entry price for SELL signals"),
        F.when(~confidence_score.between(0.0, 1.0), "Confidence score must be between 0.0 and 1.0"),
    ]
    warnings = [
        F.when(directional & F.col("position_size").isNull(), "Position size recommended for BUY/SELL signals"),
        F.when(confidence_score < 0.5, "Low confidence signal (confidence < 0.5)"),
    ]
    return signals.withColumns(
        {"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings))}
    ).withColumn("valid", F.size("errors") == 0)
