"""Returns, drawdowns, risk ratios and trade statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import count_if, ratio
from tickloom.plans.scan import running
from tickloom.plans.slices import slice_series
from tickloom.plans.small import join_small


def with_returns(
    equity: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    value: str = "portfolio_value",
    *,
    fill0: bool = False,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add ``returns``: change against the previous point of the series."""
    series = slice_series(equity, keys, [ts], lookback=1, rows_per_slice=rows_per_slice)
    change = ratio(value, F.lag(value).over(series.window)) - 1
    out = series.owned(series.df.withColumn("returns", change))
    return out.fillna(0.0, ["returns"]) if fill0 else out


def with_drawdown(
    equity: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    value: str = "portfolio_value",
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add the running ``peak`` and ``drawdown`` (<= 0)."""
    out = running(
        equity, keys, [ts], {"peak": ("max", F.col(value))}, rows_per_slice=rows_per_slice
    )
    return out.withColumn("drawdown", ratio(F.col(value) - F.col("peak"), "peak"))


def with_cumulative_return(
    returns: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add ``cumulative``: running product of 1 + return, nulls counting as 0.

    Written as a running log sum so long series can be scanned in slices; a
    return of -100 % or worse makes the product 0 from there on.
    """
    growth = 1 + F.coalesce(F.col("returns"), F.lit(0.0))
    measures = {
        "_log": ("sum", F.ln(F.when(growth > 0, growth).otherwise(1.0))),
        "_ruin": ("max", (growth <= 0).cast("int")),
    }
    out = running(returns, keys, [ts], measures, rows_per_slice=rows_per_slice)
    product = F.when(F.col("_ruin") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    return out.withColumn("cumulative", product).drop("_log", "_ruin")


def with_rolling_risk(
    returns: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    window: int = 20,
    periods_per_year: int = 252,
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add rolling annualised volatility and Sharpe over ``window`` returns."""
    series = slice_series(returns, keys, [ts], lookback=window, rows_per_slice=rows_per_slice)
    frame = series.window.rowsBetween(-(window - 1), 0)
    df = series.df.withColumns(
        {
            "_n": F.count("returns").over(frame),
            "_m": F.avg("returns").over(frame),
            "_s": F.stddev_samp("returns").over(frame),
        }
    )
    full, root = F.col("_n") == window, float(periods_per_year) ** 0.5
    df = df.withColumns(
        {
            "rolling_volatility": F.when(full, F.col("_s") * root),
            "rolling_sharpe": F.when(full, ratio("_m", "_s") * root),
        }
    ).drop("_n", "_m", "_s")
    return series.owned(df)


def performance_summary(
    equity: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    value: str = "portfolio_value",
    *,
    periods_per_year: int = 252,
    risk_free: float = 0.02,
    ddof: int = 1,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and Calmar per series.

    Undefined ratios are 0. ``ddof=0`` uses population deviations.
    """
    dated = with_drawdown(
        with_returns(equity, keys, ts, value, rows_per_slice=rows_per_slice),
        keys, ts, value, rows_per_slice=rows_per_slice,
    )
    deviation = F.stddev_samp if ddof == 1 else F.stddev_pop
    loss = F.when(F.col("returns") < 0, F.col("returns"))
    stats = dated.groupBy(*keys).agg(
        F.min_by(value, ts).alias("initial_value"),
        F.max_by(value, ts).alias("final_value"),
        # Whole days elapsed.
        F.floor(
            (F.unix_seconds(F.max(F.col(ts).cast("timestamp"))) - F.unix_seconds(F.min(F.col(ts).cast("timestamp")))) / 86400
        ).alias("days"),
        F.count("returns").alias("periods"),
        F.avg("returns").alias("mean_return"),
        deviation("returns").alias("_sd"),
        F.count(loss).alias("_losses"),
        deviation(loss).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        count_if(F.col("drawdown") < 0).alias("drawdown_periods"),
    )
    root = float(periods_per_year) ** 0.5
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = ratio("final_value", "initial_value") - 1
    annual = F.when(F.col("days") > 0, F.pow(1 + F.col("total_return"), 365 / F.col("days")) - 1).otherwise(0.0)
    excess = (F.col("mean_return") - risk_free / periods_per_year) * root
    return (
        stats.withColumn("total_return", total)
        .withColumns(
            {
                "annualized_return": annual,
                "volatility": zero(F.when(F.col("periods") > 1, F.col("_sd") * root)),
                "downside_deviation": zero(F.when(F.col("_losses") > 1, F.col("_down") * root)),
            }
        )
        .withColumns(
            {
                "sharpe_ratio": zero(F.when(F.col("volatility") > 0, ratio(excess, "volatility"))),
                "sortino_ratio": zero(
                    F.when(F.col("downside_deviation") > 0, ratio(excess, "downside_deviation"))
                ),
                "calmar_ratio": zero(ratio("annualized_return", F.abs("max_drawdown"))),
            }
        )
        .drop("_sd", "_losses", "_down")
    )


def tail_risk(
    returns: DataFrame, keys: Sequence[str], limits: DataFrame, drawdown: str = "drawdown"
) -> DataFrame:
    """VaR / CVaR, ulcer index and gain-to-pain per series.

    ``limits``: keys and ``quantiles`` (the 5 % and 1 % quantiles of returns,
    from :func:`tickloom.plans.quantiles.quantiles`).
    """
    joined = join_small(returns, limits, keys)
    r = F.col("returns")
    q05, q01 = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return joined.groupBy(*keys).agg(
        F.first(q05).alias("var_95"),
        F.first(q01).alias("var_99"),
        F.avg(F.when(r <= q05, r)).alias("cvar_95"),
        F.avg(F.when(r <= q01, r)).alias("cvar_99"),
        F.sqrt(F.avg(F.col(drawdown) * F.col(drawdown))).alias("ulcer_index"),
        ratio(F.sum(r), F.abs(F.sum(F.when(r < 0, r)))).alias("gain_to_pain"),
    )


def benchmark_risk(pairs: DataFrame, keys: Sequence[str], risk_free: float = 0.02, periods_per_year: int = 252) -> DataFrame:
    """Beta, alpha, information and Treynor ratios of ``returns`` against ``benchmark_returns``."""
    r, b = F.col("returns"), F.col("benchmark_returns")
    both = r.isNotNull() & b.isNotNull()
    r, b = F.when(both, r), F.when(both, b)
    daily = risk_free / periods_per_year
    stats = pairs.groupBy(*keys).agg(
        ratio(F.covar_samp(r, b), F.var_samp(b)).alias("beta"),
        F.avg(r).alias("_mr"),
        F.avg(b).alias("_mb"),
        F.avg(r - b).alias("_active"),
        F.stddev_samp(r - b).alias("_tracking"),
    )
    return stats.select(
        *keys,
        "beta",
        ((F.col("_mr") - daily - F.col("beta") * (F.col("_mb") - daily)) * periods_per_year).alias("alpha"),
        (ratio("_active", "_tracking") * float(periods_per_year) ** 0.5).alias("information_ratio"),
        ratio((F.col("_mr") - daily) * periods_per_year, F.col("beta")).alias("treynor_ratio"),
    )


def round_trip_fields(trips: DataFrame) -> DataFrame:
    """Add holding hours and the side-aware percentage P&L."""
    micros = F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col("entry_time").cast("timestamp"))
    long_pct = ratio(F.col("exit_price") - F.col("entry_price"), "entry_price")
    pct = F.when(F.upper("side") == "SHORT", -long_pct).otherwise(long_pct)
    return trips.withColumns({"holding_hours": micros / F.lit(3.6e9), "pnl_pct": pct * 100})


def trade_summary(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, P&L moments, best and worst, averages of winners and losers."""
    pnl = F.col("pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    return trips.groupBy(*by).agg(
        F.count("*").alias("total_trades"),
        F.count(win).alias("winning_trades"),
        F.count(loss).alias("losing_trades"),
        count_if(pnl == 0).alias("break_even_trades"),
        F.sum(pnl).alias("total_pnl"),
        F.avg(pnl).alias("average_pnl"),
        F.stddev_pop(pnl).alias("pnl_std"),
        F.max(pnl).alias("best_trade"),
        F.min(pnl).alias("worst_trade"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("average_loss"),
        F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"),
        F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"),
    )


def monthly_pnl(trips: DataFrame) -> DataFrame:
    """Sum, mean and count of P&L by exit month."""
    return trips.groupBy(F.date_format("exit_time", "yyyy-MM").alias("month")).agg(
        F.round(F.sum("pnl"), 4).alias("pnl_sum"),
        F.round(F.avg("pnl"), 4).alias("pnl_mean"),
        F.count("pnl").alias("pnl_count"),
    )


def trade_statistics(
    legs: DataFrame, by: Sequence[str] = (), profit_factor: str = "sum", pnl: str = "pnl"
) -> DataFrame:
    """Buys, sells, wins, losses, win rate and profit factor of a leg log.

    Statistics over P&L use the closing (sell) legs. ``profit_factor`` is
    'sum' (total won / total lost) or 'avg' (average win / average loss).
    """
    closing = F.when(F.col("action") == "sell", F.col(pnl))
    win, loss = F.when(closing > 0, closing), F.when(closing < 0, closing)
    pick = F.sum if profit_factor == "sum" else F.avg
    return legs.groupBy(*by).agg(
        count_if(F.col("action") == "buy").alias("buys"),
        count_if(F.col("action") == "sell").alias("sells"),
        F.count(win).alias("wins"),
        F.count(loss).alias("losses"),
        F.coalesce(ratio(F.count(win), F.count(closing)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.abs(F.avg(loss)), F.lit(0.0)).alias("average_loss"),
        F.coalesce(ratio(pick(win), F.abs(pick(loss))), F.lit(0.0)).alias("profit_factor"),
    )


def ledger_totals(legs: DataFrame, by: Sequence[str], initial_capital: float) -> DataFrame:
    """Return on capital, final value, win rate over closed trips, and leg counts."""
    closed = F.when(F.col("action") == "sell", F.col("pnl"))
    return legs.groupBy(*by).agg(
        F.coalesce(F.sum(closed), F.lit(0.0)).alias("total_pnl"),
        (initial_capital + F.coalesce(F.sum(closed), F.lit(0.0))).alias("final_value"),
        (F.coalesce(F.sum(closed), F.lit(0.0)) / initial_capital).alias("total_return"),
        F.count(closed).alias("closed_trades"),
        F.count("*").alias("legs"),
        count_if(closed > 0).alias("winning_trades"),
        F.coalesce(ratio(count_if(closed > 0), F.count(closed)), F.lit(0.0)).alias("win_rate"),
        # Counts both legs of a trip, as older reports did.
        F.coalesce(ratio(count_if(closed > 0), F.count("*")), F.lit(0.0)).alias("win_rate_by_leg"),
    )


def portfolio_ratios(states: DataFrame) -> DataFrame:
    """Leverage and margin level of portfolio states."""
    return states.withColumns(
        {
            "leverage": ratio("total_exposure", "total_equity"),
            "margin_level": ratio("total_equity", "margin_used"),
        }
    )


def validate_results(results: DataFrame) -> DataFrame:
    """Consistency of run results: ``errors``, ``warnings`` and ``valid``."""
    errors = F.array(
        F.when(F.col("start_date") >= F.col("end_date"), "Start date must be before end date"),
        F.when(
            F.col("total_trades") != F.col("recorded_trades"),
            "Trade count mismatch between metrics and trade records",
        ),
    )
    warnings = F.array(
        F.when(F.col("recorded_trades") == 0, "No trades recorded in backtest"),
        F.when(F.abs("total_return") > 10, "Extremely high total return - verify calculations"),
        F.when(F.col("max_drawdown") > 1, "Maximum drawdown exceeds 100% - verify calculations"),
    )
    return results.withColumns(
        {"errors": F.array_compact(errors), "warnings": F.array_compact(warnings)}
    ).withColumn("valid", F.size("errors") == 0)
