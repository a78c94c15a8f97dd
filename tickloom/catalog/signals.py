"""Signal labelling, trade outcomes, ledgers and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import HOURLY_BARS, SIGNALS, TICK_BARS, TICK_LEGS, labelled, rnd
from tickloom.config import FeatureConfig, ParameterGrid, TradeConfig
from tickloom.functions.numeric import rounded
from tickloom.operators import signals as sg
from tickloom.operators import trades as td
from tickloom.operators.features import compute_features
from tickloom.sources.tables import hourly_bars, leg_bars, signals, table, tick_bars, tick_legs

# The labels read two averages and the RSI only.
CFG = FeatureConfig(ma=(20, 50), ema=(), regression=(), momentum=())
HOURLY = labelled(HOURLY_BARS, "bars")
TICKS = labelled(TICK_BARS, "raw")
TRADES = TradeConfig()


def labelled_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.label_signals(compute_features(hourly_bars(spark, sf_dir), CFG, ["trend_momentum"]))


def labelled_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.label_signals(compute_features(tick_bars(spark, sf_dir), CFG, ["trend_momentum"]))


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


@query("label_signals", f"WITH {TICKS} SELECT symbol, ts, signal, strategy FROM labelled")
def label_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_ticks(spark, sf_dir).select("symbol", "ts", "signal", "strategy")


@query(
    "signal_mix",
    f"WITH {HOURLY} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, signal, strategy, count(*) AS n FROM labelled GROUP BY ALL",
)
def signal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts").cast("string").alias("date")
    return sg.signal_mix(labelled_hourly(spark, sf_dir), ["symbol", day])


@query(
    "signal_ids",
    f"WITH {HOURLY} SELECT concat_ws('_', symbol, upper(signal), strftime(ts, '%Y%m%d_%H%M%S')) AS signal_id FROM labelled WHERE signal <> 'hold'",
)
def signal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_hourly(spark, sf_dir).where(F.col("signal") != "hold")
    return df.withColumn("signal_type", F.upper("signal")).select(sg.signal_id().alias("signal_id"))


@query(
    "signal_filters",
    f"""WITH {TICKS}, {SIGNALS} SELECT symbol, ts, signal_type, signal_strength, confidence_score FROM signals
    WHERE signal_type IN ('BUY', 'SELL') AND symbol IN ('click', 'view') AND signal_strength IN ('STRONG', 'EXTREME')
      AND signal_source = 'TECHNICAL_INDICATOR' AND confidence_score >= 0.7""",
)
def signal_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sg.filter_signals(
        signals(labelled_ticks(spark, sf_dir)),
        kinds=["BUY", "SELL"], symbols=["click", "view"], strengths=["STRONG", "EXTREME"],
        sources=["TECHNICAL_INDICATOR"], min_confidence=0.7,
    )
    return kept.select("symbol", "ts", "signal_type", "signal_strength", "confidence_score")


_KIND_COUNTS = " UNION ALL ".join(
    f"SELECT '{m}' AS member, count(*) FILTER (signal_type = '{m}') AS n FROM signals" for m in sg.SIGNAL_TYPES
)


@query("signal_type_counts", f"WITH {TICKS}, {SIGNALS} {_KIND_COUNTS}")
def signal_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.enum_counts(signals(labelled_ticks(spark, sf_dir)), "signal_type", sg.SIGNAL_TYPES)


_SUMMARY = ", ".join(
    f"count(*) FILTER ({column} = '{m}') AS n_{m.lower()}"
    for column, members in (
        ("signal_type", sg.SIGNAL_TYPES), ("signal_strength", sg.SIGNAL_STRENGTHS), ("signal_source", sg.SIGNAL_SOURCES),
    )
    for m in members
)


@query(
    "signal_summary",
    f"""WITH {TICKS}, {SIGNALS} SELECT count(*) AS total_signals, {_SUMMARY}, {rnd('avg(confidence_score)')} AS confidence_mean,
    {rnd('stddev_pop(confidence_score)')} AS confidence_std, min(confidence_score) AS confidence_min, max(confidence_score) AS confidence_max,
    count(DISTINCT symbol) AS symbols, min(ts) AS first_signal, max(ts) AS last_signal FROM signals""",
)
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sg.signal_summary(signals(labelled_ticks(spark, sf_dir))), "confidence_mean", "confidence_std")


@query(
    "signal_risk_metrics",
    f"""WITH {TICKS}, {SIGNALS}, s AS (SELECT symbol, ts, nullif(entry_price, 0) AS e, nullif(stop_loss, 0) AS sl, nullif(take_profit, 0) AS tp FROM signals)
    SELECT symbol, ts, {rnd('abs(e - sl)', 7)} AS risk_per_share, {rnd('abs(e - sl) / e')} AS risk_pct, {rnd('abs(tp - e)', 7)} AS reward_per_share,
    {rnd('abs(tp - e) / e')} AS reward_pct, {rnd('CASE WHEN abs(e - sl) > 1e-9 THEN abs(tp - e) / abs(e - sl) END', 3)} AS risk_reward_ratio FROM s""",
)
def signal_risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.with_risk_metrics(signals(labelled_ticks(spark, sf_dir)))
    df = df.select("symbol", "ts", "risk_per_share", "risk_pct", "reward_per_share", "reward_pct", "risk_reward_ratio")
    return r6(r6(r6(df, "risk_pct", "reward_pct"), "risk_per_share", "reward_per_share", places=7), "risk_reward_ratio", places=3)


_BOTH = "stop_loss <> 0 AND take_profit <> 0"


@query(
    "signal_validation",
    f"""WITH {TICKS}, {SIGNALS}, v AS (SELECT symbol, ts,
      list_filter([CASE WHEN signal_type IN ('BUY', 'SELL') AND entry_price IS NULL THEN 'Entry price required for BUY/SELL signals' END,
        CASE WHEN {_BOTH} AND signal_type = 'BUY' AND stop_loss >= entry_price THEN 'Stop loss must be below entry price for BUY signals' END,
        CASE WHEN {_BOTH} AND signal_type = 'BUY' AND take_profit <= entry_price THEN 'Take profit must be above entry price for BUY signals' END,
        CASE WHEN {_BOTH} AND signal_type = 'SELL' AND stop_loss <= entry_price THEN 'Stop loss must be above entry price for SELL signals' END,
        CASE WHEN {_BOTH} AND signal_type = 'SELL' AND take_profit >= entry_price THEN 'Take profit must be below entry price for SELL signals' END,
        CASE WHEN confidence_score NOT BETWEEN 0 AND 1 THEN 'Confidence score must be between 0.0 and 1.0' END], lambda x: x IS NOT NULL) AS errors,
      list_filter([CASE WHEN signal_type IN ('BUY', 'SELL') AND position_size IS NULL THEN 'Position size recommended for BUY/SELL signals' END,
        CASE WHEN confidence_score < 0.5 THEN 'Low confidence signal (confidence < 0.5)' END], lambda x: x IS NOT NULL) AS warnings FROM signals)
    SELECT symbol, ts, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings, len(errors) = 0 AS valid FROM v""",
)
def signal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.with_validation(signals(labelled_ticks(spark, sf_dir))).select(
        "symbol", "ts", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "valid"
    )


@query(
    "signal_confidence",
    f"""WITH {TICKS}, s AS (SELECT symbol, ts, rsi_14 / 100 AS rsi, volume / 100 AS activity FROM labelled),
    c AS (SELECT *, (coalesce(rsi * 0.7, 0) + coalesce(activity * 0.3, 0))
      / nullif(CASE WHEN rsi IS NULL THEN 0 ELSE 0.7 END + CASE WHEN activity IS NULL THEN 0 ELSE 0.3 END, 0) AS f FROM s)
    SELECT symbol, ts, {rnd('coalesce(greatest(least((0.5 + f) / 2, 1.0), 0.0), 0.5)')} AS confidence FROM c""",
)
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_ticks(spark, sf_dir).select(
        "symbol", "ts", (F.col("rsi_14") / 100).alias("rsi"), (F.col("volume") / 100).alias("activity")
    )
    score = sg.confidence({"rsi": 0.7, "activity": 0.3})
    return df.select("symbol", "ts", rounded(score).alias("confidence"))


_BARRIER = f"""{HOURLY}, hits AS (SELECT b.symbol, b.ts, b.close, (SELECT arg_min({{'ts': l.ts, 'close': l.close}}, l.ts) FROM labelled l
  WHERE l.symbol = b.symbol AND l.ts > b.ts AND (l.close <= b.close * (1 - 0.05) OR l.close >= b.close * (1 + 0.10) OR l.signal = 'sell')) AS x
  FROM labelled b WHERE b.signal = 'buy')"""
_REASON = """CASE WHEN x IS NULL THEN 'open' WHEN x.close <= close * (1 - 0.05) THEN 'stop_loss'
  WHEN x.close >= close * (1 + 0.10) THEN 'take_profit' ELSE 'signal' END"""


@query(
    "barrier_outcomes",
    f"WITH {_BARRIER} SELECT symbol, ts AS entry_time, close AS entry_price, x.ts AS exit_time, x.close AS exit_price, {_REASON} AS exit_reason FROM hits",
)
def barrier_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.barrier_outcomes(labelled_hourly(spark, sf_dir), TRADES)


_FIRST = f"""{HOURLY}, entry AS (SELECT symbol, min(ts) AS entry_time, arg_min(close, ts) AS entry_price FROM labelled WHERE signal = 'buy' GROUP BY 1),
later AS (SELECT l.symbol, min(l.ts) AS exit_time, arg_min(l.close, l.ts) AS exit_price FROM labelled l JOIN entry e ON l.symbol = e.symbol
  WHERE l.ts > entry_time AND (l.close <= entry_price * (1 - 0.05) OR l.close >= entry_price * (1 + 0.10) OR l.signal = 'sell') GROUP BY 1),
trips AS (SELECT e.*, exit_time, exit_price, CASE WHEN exit_price IS NULL THEN 'open' WHEN exit_price <= entry_price * (1 - 0.05) THEN 'stop_loss'
  WHEN exit_price >= entry_price * (1 + 0.10) THEN 'take_profit' ELSE 'signal' END AS exit_reason FROM entry e LEFT JOIN later USING (symbol))"""


@query("first_round_trip", f"WITH {_FIRST} SELECT * FROM trips")
def first_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.first_round_trip(labelled_hourly(spark, sf_dir), TRADES)


_COST = "(0.001 + 5.0 / 10000)"


@query(
    "trade_ledger",
    f"""WITH {_BARRIER}, t AS (SELECT symbol, ts AS entry_time, close AS entry_price, x.ts AS exit_time, x.close AS exit_price, 5000.0 / nullif(close, 0) AS q FROM hits),
    legs AS (SELECT symbol, entry_time AS "timestamp", 'buy' AS action, q AS quantity, entry_price AS price, 5000.0 * {_COST} AS costs, 0.0 AS pnl, -(5000.0 + 5000.0 * {_COST}) AS cash_flow FROM t
    UNION ALL SELECT symbol, exit_time, 'sell', q, exit_price, q * exit_price * {_COST}, (exit_price - entry_price) * q - q * exit_price * {_COST}, q * exit_price - q * exit_price * {_COST} FROM t WHERE exit_time IS NOT NULL)
    SELECT symbol, "timestamp", action, price, {rnd('quantity', 5)} AS quantity, {rnd('costs', 5)} AS costs, {rnd('pnl', 5)} AS pnl, {rnd('cash_flow', 5)} AS cash_flow FROM legs""",
)
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = td.barrier_outcomes(labelled_hourly(spark, sf_dir), TRADES)
    return r6(td.trade_ledger(trips, TRADES), "quantity", "costs", "pnl", "cash_flow", places=5)


_GRID = ParameterGrid()
_GRID_SQL = f"""{HOURLY}, grid AS (SELECT s, t FROM (SELECT unnest({list(_GRID.stop_loss_pct)}) AS s), (SELECT unnest({list(_GRID.take_profit_pct)}) AS t)),
ex AS (SELECT s, t, b.symbol, b.ts AS entered, b.close AS c, min(l.ts) AS left_at, arg_min(l.close, l.ts) AS x FROM labelled b CROSS JOIN grid LEFT JOIN labelled l
  ON l.symbol = b.symbol AND l.ts > b.ts AND (l.close <= b.close * (1 - s) OR l.close >= b.close * (1 + t) OR l.signal = 'sell')
  WHERE b.signal = 'buy' GROUP BY ALL),
g AS (SELECT s, t, left_at, x / c - 1 - x / c * {_COST} AS gain FROM ex),
a AS (SELECT s, t, count(*) AS entries, count(gain) AS closed_trades, count(*) FILTER (gain > 0) AS wins, coalesce(sum(gain), 0) AS gain FROM g GROUP BY 1, 2),
m AS (SELECT s, t, left_at, sum(gain) AS gain FROM g WHERE left_at IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, sum(gain) OVER (PARTITION BY s, t ORDER BY left_at ROWS UNBOUNDED PRECEDING) AS total FROM m),
p AS (SELECT *, greatest(max(total) OVER (PARTITION BY s, t ORDER BY left_at ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c),
sizes AS (SELECT unnest({list(_GRID.max_position_size)}) AS z),
q AS (SELECT s, t, z, min(z * (total - peak) / (1 + z * peak)) AS max_drawdown, avg(z * gain / (1 + z * (total - gain))) AS mu,
  stddev_samp(z * gain / (1 + z * (total - gain))) AS sd FROM p, sizes GROUP BY 1, 2, 3),
ranked AS (SELECT CAST(s AS DOUBLE) AS stop_loss_pct, CAST(t AS DOUBLE) AS take_profit_pct, CAST(z AS DOUBLE) AS max_position_size, CAST(entries AS BIGINT) AS entries,
  CAST(closed_trades AS BIGINT) AS closed_trades, {rnd('wins / closed_trades')} AS win_rate, {rnd('gain * z')} AS total_return, {rnd('100000.0 * (1 + gain * z)', 4)} AS final_equity,
  {rnd('coalesce(max_drawdown, 0)')} AS max_drawdown, {rnd('coalesce(mu / nullif(sd, 0) * sqrt(1440), 0)', 5)} AS sharpe_ratio
  FROM (SELECT * FROM a, sizes) LEFT JOIN q USING (s, t, z))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = td.grid_rank(labelled_hourly(spark, sf_dir), _GRID, TRADES)
    return r6(r6(r6(ranked, "win_rate", "total_return", "max_drawdown"), "final_equity", places=4), "sharpe_ratio", places=5)


@query("grid_rank", f"WITH {_GRID_SQL} SELECT * FROM ranked")
def grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(
    "grid_top5",
    f"WITH {_GRID_SQL} SELECT * FROM ranked ORDER BY total_return DESC, stop_loss_pct, take_profit_pct, max_position_size LIMIT 5",
)
def grid_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).limit(5)


_SIGNED = "CASE WHEN action = 'buy' THEN quantity ELSE -quantity END"


@query(
    "open_positions",
    f"WITH {TICK_LEGS} SELECT symbol, sum({_SIGNED}) AS quantity FROM tick_legs GROUP BY 1 HAVING sum({_SIGNED}) > 0",
)
def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.open_positions(tick_legs(spark, sf_dir))


@query(
    "open_positions_ordered",
    f"""WITH {TICK_LEGS}, s AS (SELECT symbol, {_SIGNED} AS q, sum({_SIGNED}) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM tick_legs)
    SELECT symbol, sum(q) - least(min(run), 0) AS quantity FROM s GROUP BY 1 HAVING sum(q) - least(min(run), 0) > 0""",
)
def open_positions_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.open_positions_ordered(tick_legs(spark, sf_dir), ["ts", "event_id"])


_LEG_BARS = f"""{TICK_LEGS}, leg_bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, row(ts, event_id)) AS close FROM tick_legs GROUP BY 1, 2),
held AS (SELECT b.symbol, b.ts, b.close, coalesce((SELECT sum({_SIGNED}) FROM tick_legs l WHERE l.symbol = b.symbol AND l.ts <= b.ts), 0.0) AS quantity FROM leg_bars b)"""


@query("position_asof", f"WITH {_LEG_BARS} SELECT * FROM held")
def position_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.position_asof(leg_bars(spark, sf_dir), tick_legs(spark, sf_dir))


@query(
    "position_value",
    f"""WITH {_LEG_BARS}, moves AS (SELECT symbol, date_trunc('day', ts) AS ts, sum({_SIGNED}) AS quantity FROM tick_legs GROUP BY 1, 2)
    SELECT m.symbol, m.ts, m.quantity, round(coalesce(m.quantity * b.close, 0.0), 4) + 0.0 AS value FROM moves m LEFT JOIN leg_bars b ON m.symbol = b.symbol AND m.ts = b.ts""",
)
def position_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = tick_legs(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(td.signed_quantity()).alias("quantity")
    )
    return td.position_value(moves, leg_bars(spark, sf_dir)).select(
        "symbol", "ts", "quantity", rounded("value", 4).alias("value")
    )


@query(
    "equity_curve",
    f"""WITH {_LEG_BARS}, v AS (SELECT ts, sum(CASE WHEN quantity > 0 THEN quantity * close ELSE 0 END) AS positions_value FROM held GROUP BY 1),
    c AS (SELECT *, 100000.0 + coalesce((SELECT sum(-({_SIGNED}) * price) FROM tick_legs l WHERE l.ts <= v.ts), 0) AS cash FROM v)
    SELECT ts AS "timestamp", {rnd('cash + positions_value', 4)} AS portfolio_value, {rnd('cash', 4)} AS cash, {rnd('positions_value', 4)} AS positions_value FROM c""",
)
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = tick_legs(spark, sf_dir).withColumn("cash_flow", -td.signed_quantity() * F.col("price"))
    curve = td.equity_curve(leg_bars(spark, sf_dir), legs, 100_000.0)
    return r6(curve, "portfolio_value", "cash", "positions_value", places=4)


@query(
    "trade_costs",
    f"""WITH v AS (SELECT event_id, value * {100.0} AS x FROM events)
    SELECT event_id, {rnd(f'x * {_COST}', 10)} AS cost, {rnd('x * (15.0 + 10.0 + least(5.0 * x / 10000.0, 20.0)) / 10000 * (1 + 0.1)', 10)} AS taker_cost,
    {rnd('x * (5.0 + 10.0 + least(5.0 * x / 10000.0, 20.0)) / 10000 * (1 + 0.1)', 10)} AS maker_cost FROM v""",
)
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value") * 100.0
    return table(spark, sf_dir, "events").select(
        "event_id",
        rounded(td.trade_cost(value), 10).alias("cost"),
        rounded(td.venue_cost(value), 10).alias("taker_cost"),
        rounded(td.venue_cost(value, maker=True), 10).alias("maker_cost"),
    )
