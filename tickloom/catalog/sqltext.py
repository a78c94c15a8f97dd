"""SQL fragments shared by the SQL texts of the queries."""

from __future__ import annotations

VOLUME = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"

TICK_BARS = f"""raw AS (
  SELECT event_type AS symbol, ts, round(value * 0.99, 6) AS open, round(value * (1.01 + {VOLUME} / 1000), 6) AS high,
         round(value * (0.99 - {VOLUME} / 1000), 6) AS low, value AS close, {VOLUME} AS volume
  FROM events)"""

HOURLY_BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

DAILY_BARS = """daily AS (
  SELECT symbol, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, o) AS close, sum(l_quantity) AS volume
  FROM (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o, l_quantity FROM lineitem)
  GROUP BY 1, 2)"""

PNL = "round(l_extendedprice * (l_discount - l_tax), 4)"

TRADES = f"""trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id,
         l_returnflag AS symbol, o_orderpriority AS strategy,
         least(o_orderdate, l_shipdate) AS entry_time, greatest(o_orderdate, l_shipdate) AS exit_time,
         l_extendedprice / l_quantity AS entry_price,
         l_extendedprice / l_quantity * (1 + l_discount - l_tax) AS exit_price,
         l_quantity AS position_size,
         CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS side,
         {PNL} AS pnl, l_suppkey AS run_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

LEGS = f"""legs AS (
  SELECT concat('run-', lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS run_id, l_shipdate AS "timestamp", l_returnflag AS symbol,
         CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS action, l_quantity AS quantity,
         l_extendedprice / l_quantity AS price,
         l_extendedprice / l_quantity * (1 + l_discount / 100) AS execution_price,
         l_extendedprice * l_tax / 100 AS fees, {PNL} AS pnl,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS leg_id
  FROM lineitem)"""

TICK_LEGS = f"""tick_legs AS (
  SELECT concat('s', user_id % 5) AS symbol, ts, event_id,
         CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'buy' ELSE 'sell' END AS action,
         {VOLUME} AS quantity, value AS price
  FROM events)"""

RUNS = f"""run_trades AS (
  SELECT l_suppkey AS run_key, l_returnflag AS symbol, l_quantity, l_linestatus, l_shipdate, {PNL} AS pnl
  FROM lineitem),
positions AS (
  SELECT run_key, symbol, sum(l_quantity) AS quantity FROM run_trades
  WHERE l_linestatus = 'O' GROUP BY 1, 2),
runs AS (
  SELECT concat('run-', lpad(CAST(run_key AS VARCHAR), 8, '0')) AS run_id, run_key, max(l_shipdate) AS finished_at,
         count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades,
         count(*) FILTER (pnl < 0) AS losing_trades, round(sum(pnl), 4) AS total_pnl,
         avg(pnl) / stddev_samp(pnl) AS sharpe_ratio,
         count(*) FILTER (pnl > 0) / count(*) AS hit_rate,
         -abs(round(sum(pnl), 4)) / 1000000.0 AS max_drawdown, 1000000.0 AS initial_equity,
         1000000.0 + round(sum(pnl), 4) AS final_equity,
         round(sum(pnl), 4) / 1000000.0 * 100 AS total_return_pct
  FROM run_trades GROUP BY run_key)"""

ERRORS = """errors AS (
  SELECT ts AS "timestamp", concat('E', user_id % 7) AS error_type,
         CASE WHEN value > 150 THEN 'critical' WHEN value > 60 THEN 'error' ELSE 'warning' END AS severity
  FROM events WHERE event_type = 'error')"""

ANALYSES = f"""analyses AS (
  SELECT ts AS "timestamp", concat('SYM', user_id % 10) AS symbol,
         CASE event_type WHEN 'click' THEN 'hold' WHEN 'view' THEN 'enter_long'
              WHEN 'signup' THEN 'enter_short' WHEN 'purchase' THEN 'exit' END AS action_type,
         {VOLUME} / 100 AS confidence, round(value * 10, 2) AS latency_ms
  FROM events)"""

SERIES = "PARTITION BY symbol ORDER BY ts"


def equity(key: str) -> str:
    return f"""daily_pnl AS (SELECT {key}, exit_time AS "timestamp", round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1, 2),
equity AS (SELECT {key}, "timestamp", round(1000000.0 + sum(pnl) OVER (PARTITION BY {key} ORDER BY "timestamp"), 4) AS portfolio_value FROM daily_pnl)"""


def labelled(bars_sql: str, bars: str) -> str:
    """CTE ``labelled``: symbol, ts, close, volume, ma_20, ma_50, rsi_14, signal, strategy."""
    gain, loss = full("avg", "gain", 14), full("avg", "loss", 14)
    rules = [
        ("momentum", "buy", "close > ma_20 * 1.005 AND rsi_14 < 70"),
        ("momentum", "sell", "close < ma_20 * 0.995 AND rsi_14 > 30"),
        ("rsi_extreme", "buy", "rsi_14 < 30"),
        ("rsi_extreme", "sell", "rsi_14 > 75"),
        ("trend", "buy", "ma_20 > ma_50 AND close > ma_20 * 1.003"),
        ("trend", "sell", "ma_20 < ma_50 AND close < ma_20 * 0.997"),
        ("breakout", "buy", "close > ma_20 * 1.01"),
        ("breakout", "sell", "close < ma_20 * 0.99"),
        ("rsi_shift", "buy", "rsi_14 BETWEEN 35 AND 45 AND close > ma_20 * 0.999"),
        ("rsi_shift", "sell", "rsi_14 BETWEEN 55 AND 65 AND close < ma_20 * 1.001"),
    ]
    known = "ma_20 IS NULL OR ma_50 IS NULL OR rsi_14 IS NULL"
    signal = " ".join(f"WHEN {c} THEN '{s}'" for _, s, c in rules)
    strategy = " ".join(f"WHEN {c} THEN '{n}'" for n, _, c in rules)
    return f"""{bars_sql}, delta AS (SELECT *, close - {lag('close')} AS d FROM {bars}),
moves AS (SELECT *, coalesce(greatest(d, 0), 0) AS gain, coalesce(greatest(-d, 0), 0) AS loss FROM delta),
indicators AS (SELECT symbol, ts, close, volume, {full('avg', 'close', 20)} AS ma_20, {full('avg', 'close', 50)} AS ma_50,
  CASE WHEN ({loss}) = 0 AND ({gain}) > 0 THEN 100.0 ELSE 100 - 100 / (1 + ({gain}) / nullif({loss}, 0)) END AS rsi_14 FROM moves),
labelled AS (SELECT *, CASE WHEN {known} THEN 'hold' {signal} ELSE 'hold' END AS signal,
  CASE WHEN {known} THEN NULL {strategy} END AS strategy FROM indicators)"""


SIGNALS = """signals AS (SELECT symbol, ts, upper(signal) AS signal_type,
  CASE WHEN volume < 25 THEN 'WEAK' WHEN volume < 50 THEN 'MODERATE' WHEN volume < 75 THEN 'STRONG' ELSE 'EXTREME' END AS signal_strength,
  CASE WHEN strategy = 'trend' THEN 'REGIME_DETECTION' WHEN strategy IS NULL THEN 'RISK_MANAGEMENT' ELSE 'TECHNICAL_INDICATOR' END AS signal_source,
  volume / 100 AS confidence_score, CASE WHEN volume <> 33 THEN close END AS entry_price, CASE WHEN volume >= 10 THEN volume END AS position_size,
  CASE WHEN volume = 12 THEN 0.0 ELSE close * (0.8 + volume / 300) END AS stop_loss, close * (1.2 - volume / 400) AS take_profit FROM labelled)"""


def frame(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(aggregate: str, column: str, n: int) -> str:
    """Rolling aggregate that needs ``n`` non-null inputs; ``{}`` marks the column."""
    call = aggregate.format(column) if "{}" in aggregate else f"{aggregate}({column})"
    return f"CASE WHEN count({column}) OVER {frame(n)} = {n} THEN {call} OVER {frame(n)} END"


def lag(column: str, k: int = 1) -> str:
    return f"lag({column}, {k}) OVER ({SERIES})"


def rnd(expression: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0"
