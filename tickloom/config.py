"""Parameters of the engine as frozen dataclasses."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class FeatureConfig:
    """Windows and thresholds of the feature families (counts are in bars)."""

    returns: tuple[int, ...] = (1, 5, 15)
    ma: tuple[int, ...] = (20, 50, 100)
    ema: tuple[int, ...] = (20, 50)
    momentum: tuple[int, ...] = (10, 20)
    regression: tuple[int, ...] = (20, 240, 720)
    breakout: int = 20
    rsi: tuple[int, ...] = (14,)
    rsi_smoothing: str = "sma"  # or "wilder"
    bollinger: tuple[int, ...] = (20,)
    stochastic: tuple[int, ...] = (14,)
    stochastic_smooth: int = 3
    williams: tuple[int, ...] = (14,)
    cci: tuple[int, ...] = (20,)
    atr: tuple[int, ...] = (14,)
    volatility: tuple[int, ...] = (20, 50)
    var_window: tuple[int, ...] = (20,)
    volume: tuple[int, ...] = (20, 50)
    vwap: int = 20
    efficiency: tuple[int, ...] = (20,)
    trend: tuple[int, ...] = (20, 50)
    liquidity: tuple[int, ...] = (20,)
    position: tuple[int, ...] = (20,)
    bars_per_day: int = 1440
    volume_spike_multiplier: float = 2.0
    stop_atr_multiplier: float = 2.0
    # Fraction in [0, 1]. 0.008 reproduces the historical percent/100 reading.
    volatility_quantile: float = 0.80
    volatility_mode: str = "full_sample"  # or "expanding"
    winsorize: bool = False
    winsorize_fraction: float = 0.01
    version: str = "1.0"


@dataclass(frozen=True)
class QualityConfig:
    """Ingest and quality-control limits."""

    min_coverage_pct: float = 99.9
    critical_coverage_pct: float = 95.0
    warning_coverage_pct: float = 99.0
    max_price_change: float = 0.5
    min_volume: float = 0.0
    max_gap_minutes: int = 60
    alert_gap_hours: int = 24
    bar_minutes: int = 1
    min_non_na: float = 0.95
    # Earlier entries win when the same bar arrives from several sources.
    source_priority: tuple[str, ...] = ("binance:dump", "binance:rest")


@dataclass(frozen=True)
class TradeConfig:
    """Capital, risk and cost assumptions of trade evaluation."""

    initial_capital: float = 100_000.0
    commission_rate: float = 0.001
    slippage_bps: float = 5.0
    max_position_size: float = 0.05
    stop_loss_pct: float = 0.05
    take_profit_pct: float = 0.10


@dataclass(frozen=True)
class CostModel:
    """Venue cost table, basis points unless the name says otherwise."""

    taker_fee_bps: float = 15.0
    maker_fee_bps: float = 5.0
    slippage_bps: float = 10.0
    max_slippage_bps: float = 50.0
    impact_bps_per_block: float = 5.0
    impact_block_usd: float = 10_000.0
    max_impact_bps: float = 20.0
    buffer_pct: float = 0.1


@dataclass(frozen=True)
class ParameterGrid:
    """Stop / target / size combinations to rank."""

    stop_loss_pct: tuple[float, ...] = (0.02, 0.03, 0.05, 0.08)
    take_profit_pct: tuple[float, ...] = (0.05, 0.08, 0.10, 0.15)
    max_position_size: tuple[float, ...] = (0.02, 0.03, 0.05, 0.08)


@dataclass(frozen=True)
class SignalRules:
    """Thresholds of the five prioritised strategies."""

    momentum_up: float = 1.005
    momentum_down: float = 0.995
    momentum_rsi_max: float = 70.0
    momentum_rsi_min: float = 30.0
    rsi_low: float = 30.0
    rsi_high: float = 75.0
    trend_up: float = 1.003
    trend_down: float = 0.997
    breakout_up: float = 1.01
    breakout_down: float = 0.99
    shift_buy: tuple[float, float] = (35.0, 45.0)
    shift_sell: tuple[float, float] = (55.0, 65.0)
    shift_buy_ratio: float = 0.999
    shift_sell_ratio: float = 1.001


@dataclass(frozen=True)
class EngineConfig:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    trades: TradeConfig = field(default_factory=TradeConfig)


def config_hash(config: object) -> str:
    """First 16 hex digits of the sha-256 of the key-sorted JSON form."""
    payload = config if isinstance(config, dict) else asdict(config)
    text = json.dumps(payload, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]
