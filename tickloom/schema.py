"""Explicit schemas (DDL text) of every record the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def parse(ddl: str) -> T.StructType:
    """DDL text as a StructType; needs a running session."""
    return T.StructType.fromDDL(ddl)


# Column orders of raw CSV files, by kind of file.
RAW_LAYOUTS = {
    "kline": (
        "open_time bigint, open double, high double, low double, close double, volume double, "
        "close_time bigint, quote_volume double, n_trades bigint, taker_buy_base double, "
        "taker_buy_quote double, ignore string"
    ),
    "rest": (
        "ts string, ts_raw bigint, symbol string, open double, high double, low double, close double, "
        "volume double, source string, load_id string"
    ),
    "documented": (
        "ts_raw bigint, open double, high double, low double, close double, volume double, "
        "quote_volume double, n_trades bigint, source string, load_id string"
    ),
}
CANONICAL_BAR = (
    "ts timestamp, symbol string, open double, high double, low double, close double, volume double, "
    "spread_est double, source string, load_id string, ingestion_ts timestamp"
)
TICK = (
    "timestamp timestamp, symbol string, price decimal(38,18), volume decimal(38,18), side string, source string"
)
ORDER_BOOK = (
    "timestamp timestamp, symbol string, "
    "bids array<struct<price: decimal(38,18), qty: decimal(38,18)>>, "
    "asks array<struct<price: decimal(38,18), qty: decimal(38,18)>>"
)
# Twelve positions of a kline array, in order.
KLINE_FIELDS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "n_trades", "taker_buy_base", "taker_buy_quote", "ignore",
)
TRADE_LEG = (
    "timestamp timestamp, symbol string, action string, quantity double, price double, "
    "execution_price double, fees double, trade_pnl double, cash_after double, run_id string"
)
EQUITY_POINT = (
    "timestamp timestamp, portfolio_value double, cash double, positions_value double"
)
RUN_METRICS = (
    "run_id string, total_return_pct double, sharpe_ratio double, total_trades bigint, "
    "winning_trades bigint, losing_trades bigint, hit_rate double, max_drawdown double, "
    "initial_equity double, final_equity double, final_positions map<string, double>"
)
ROUND_TRIP = (
    "trade_id string, symbol string, entry_time timestamp, exit_time timestamp, entry_price double, "
    "exit_price double, position_size double, side string, pnl double, pnl_pct double, "
    "holding_period double, exit_reason string, strategy_name string, tags array<string>"
)
ERROR_EVENT = (
    "timestamp timestamp, error_type string, error_message string, severity string, "
    "context map<string, string>, traceback string"
)
ACTION_DOCUMENT = (
    "version string, intent string, symbol string, timeframe string, rationale string, "
    "action struct<type: string, confidence: double, "
    "constraints: struct<max_position_size: double, stop_loss_pct: double, take_profit_pct: double, time_horizon: string>, "
    "regime_context: struct<regime_type: string, regime_confidence: double, regime_duration: string>>, "
    "metadata struct<analysis_timestamp: string, data_sources: array<string>, indicators_used: array<string>, "
    "risk_factors: array<string>, generation_latency_ms: double>"
)
AUDIT_EVENT = (
    "timestamp timestamp, event_type string, model string, prompt string, response string, "
    "latency_ms double, token_usage map<string, bigint>, error string, symbol string, "
    "action struct<type: string, confidence: double>"
)
SIGNAL = (
    "signal_id string, signal_type string, signal_strength string, signal_source string, symbol string, "
    "timestamp timestamp, confidence_score double, description string, reasoning string, "
    "feature_values map<string, double>, model_version string, strategy_name string, created_at timestamp, "
    "entry_price double, exit_price double, position_size double, stop_loss double, take_profit double, "
    "risk_reward_ratio double, expected_return double, max_drawdown double, holding_period string"
)
FEATURE_METADATA = (
    "name string, family string, window int, method string, dependencies array<string>, "
    "expected_low double, expected_high double, description string"
)
