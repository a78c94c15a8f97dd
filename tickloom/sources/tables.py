"""Domain views over the general-purpose tables (events, lineitem, orders, ...).

No market data ships with the project, so bars, trades, runs and logs are
derived from these tables. Every view is a lazy DataFrame over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.scan import running
from tickloom.session import configure, durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event: symbol is the event type, price the value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id"
    )


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as its own bar (unique per symbol and instant), for long series."""
    value, size = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.round(value * 0.99, 6).alias("open"),
        F.round(value * (1.01 + size / 1000), 6).alias("high"),
        F.round(value * (0.99 - size / 1000), 6).alias("low"),
        value.alias("close"),
        size.alias("volume"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV bars of the ticks; volume counts ticks."""
    return aggregate_ticks(ticks(spark, sf_dir), "hour")


def aggregate_ticks(ticks_df: DataFrame, unit: str) -> DataFrame:
    """Ticks to OHLCV bars: partial aggregation, one shuffle on (symbol, ts)."""
    return (
        ticks_df.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: symbol is the return flag, price per unit."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            price.alias("price"),
            order.alias("o"),
            "l_quantity",
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("price", "o").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "o").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips: a line item bought and sold between its two dates."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    entry_price = F.col("l_extendedprice") / F.col("l_quantity")
    pnl = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 4)
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.col("l_returnflag").alias("symbol"),
        F.col("o_orderpriority").alias("strategy"),
        F.least("o_orderdate", "l_shipdate").alias("entry_time"),
        F.greatest("o_orderdate", "l_shipdate").alias("exit_time"),
        entry_price.alias("entry_price"),
        (entry_price * (1 + F.col("l_discount") - F.col("l_tax"))).alias("exit_price"),
        F.col("l_quantity").alias("position_size"),
        F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("side"),
        pnl.alias("pnl"),
        F.col("l_suppkey").alias("run_key"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed order legs: price, execution price and fee per line item."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        run_id(F.col("l_suppkey")).alias("run_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("action"),
        F.col("l_quantity").alias("quantity"),
        price.alias("price"),
        (price * (1 + F.col("l_discount") / 100)).alias("execution_price"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fees"),
        F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 4).alias("pnl"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("leg_id"),
    )


def tick_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order legs on the tick stream: purchases buy, errors sell, in the symbol's hour."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 5).alias("symbol"),
        "ts",
        "event_id",
        F.when(F.col("event_type").isin("purchase", "signup", "view"), "buy").otherwise("sell").alias("action"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.col("value").alias("price"),
    )


def run_id(key: Column) -> Column:
    return F.concat(F.lit("run-"), F.lpad(key.cast("string"), 8, "0"))


def leg_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes of the symbols :func:`tick_legs` trades."""
    legs_df = tick_legs(spark, sf_dir)
    return legs_df.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("close")
    )


def equity_by(spark: SparkSession, sf_dir: str, key: str, capital: float = 1_000_000.0) -> DataFrame:
    """Daily equity per strategy (or run): capital plus realised P&L to date."""
    daily = trades(spark, sf_dir).groupBy(key, F.col("exit_time").alias("timestamp")).agg(
        F.round(F.sum("pnl"), 4).alias("pnl")
    )
    # One row per key and day, read by several passes below: joined and summed once.
    out = running(durable(daily), [key], ["timestamp"], {"_total": ("sum", F.col("pnl"))})
    return out.select(key, "timestamp", F.round(capital + F.col("_total"), 4).alias("portfolio_value"))


def signals(labelled: DataFrame) -> DataFrame:
    """Signal records of labelled bars, some deliberately inconsistent."""
    size, close = F.col("volume"), F.col("close")
    return labelled.select(
        "symbol",
        "ts",
        F.upper("signal").alias("signal_type"),
        F.when(size < 25, "WEAK").when(size < 50, "MODERATE").when(size < 75, "STRONG").otherwise("EXTREME").alias("signal_strength"),
        F.when(F.col("strategy") == "trend", "REGIME_DETECTION")
        .when(F.col("strategy").isNull(), "RISK_MANAGEMENT")
        .otherwise("TECHNICAL_INDICATOR")
        .alias("signal_source"),
        (size / 100).alias("confidence_score"),
        F.when(size != 33, close).alias("entry_price"),
        F.when(size >= 10, size).alias("position_size"),
        F.when(size == 12, 0.0).otherwise(close * (0.8 + size / 300)).alias("stop_loss"),
        (close * (1.2 - size / 400)).alias("take_profit"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One back-test run per supplier, summarised from its line items."""
    line = table(spark, sf_dir, "lineitem")
    pnl = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 4)
    trade = line.select(
        F.col("l_suppkey").alias("run_key"),
        F.col("l_returnflag").alias("symbol"),
        "l_quantity",
        "l_linestatus",
        "l_shipdate",
        pnl.alias("pnl"),
    )
    held = (
        trade.where(F.col("l_linestatus") == "O")
        .groupBy("run_key", "symbol")
        .agg(F.sum("l_quantity").alias("quantity"))
        .groupBy("run_key")
        # At most one entry per return flag.
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "quantity")))).alias("final_positions"))
    )
    stats = trade.groupBy("run_key").agg(
        F.count("*").alias("total_trades"),
        F.count(F.when(F.col("pnl") > 0, 1)).alias("winning_trades"),
        F.count(F.when(F.col("pnl") < 0, 1)).alias("losing_trades"),
        F.round(F.sum("pnl"), 4).alias("total_pnl"),
        (F.avg("pnl") / F.stddev_samp("pnl")).alias("sharpe_ratio"),
        F.max("l_shipdate").alias("finished_at"),
    )
    capital = F.lit(1_000_000.0)
    return stats.join(held, "run_key", "left").select(
        run_id(F.col("run_key")).alias("run_id"),
        "run_key",
        "finished_at",
        "total_trades",
        "winning_trades",
        "losing_trades",
        "total_pnl",
        "sharpe_ratio",
        (F.col("winning_trades") / F.col("total_trades")).alias("hit_rate"),
        (-F.abs(F.col("total_pnl")) / capital).alias("max_drawdown"),
        capital.alias("initial_equity"),
        (capital + F.col("total_pnl")).alias("final_equity"),
        (F.col("total_pnl") / capital * 100).alias("total_return_pct"),
        "final_positions",
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events with a severity banded by value and a type per user group."""
    value = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("E"), F.col("user_id") % 7).alias("error_type"),
            F.when(value > 150, "critical").when(value > 60, "error").otherwise("warning").alias("severity"),
        )
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory analyses: one per event, with latency, confidence and action type."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("SYM"), F.col("user_id") % 10).alias("symbol"),
        F.struct(
            F.when(F.col("event_type") == "click", "hold")
            .when(F.col("event_type") == "view", "enter_long")
            .when(F.col("event_type") == "signup", "enter_short")
            .when(F.col("event_type") == "purchase", "exit")
            .otherwise(F.lit(None).cast("string"))
            .alias("type"),
            (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        ).alias("action"),
        F.round(F.col("value") * 10, 2).alias("latency_ms"),
    )
