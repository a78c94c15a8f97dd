"""Performance, trade-statistics and run-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import LEGS, RUNS, TICK_LEGS, TRADES, equity, rnd
from tickloom.functions.numeric import rounded
from tickloom.operators import performance as pf
from tickloom.operators import runs as rn
from tickloom.operators import trades as td
from tickloom.plans.quantiles import quantiles
from tickloom.sources.tables import equity_by, legs, run_id, runs, table, tick_legs, trades

EQ = f"{TRADES}, {equity('strategy')}"
RUN_EQ = f"{TRADES}, {equity('run_key')}"
_BY = 'PARTITION BY strategy ORDER BY "timestamp"'
RET = f"""{EQ}, ret AS (SELECT *, portfolio_value / nullif(lag(portfolio_value) OVER ({_BY}), 0) - 1 AS r,
  max(portfolio_value) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS peak FROM equity),
dd AS (SELECT *, (portfolio_value - peak) / nullif(peak, 0) AS d FROM ret)"""


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


def strategy_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity_by(spark, sf_dir, "strategy")


@query("equity_returns", f'WITH {RET} SELECT strategy, "timestamp", {rnd("coalesce(r, 0)", 8)} AS returns FROM ret')
def equity_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_returns(strategy_equity(spark, sf_dir), ["strategy"], fill0=True)
    return df.select("strategy", "timestamp", rounded("returns", 8).alias("returns"))


@query("drawdown", f'WITH {RET} SELECT strategy, "timestamp", {rnd("peak", 4)} AS peak, {rnd("d")} AS drawdown FROM dd')
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_drawdown(strategy_equity(spark, sf_dir), ["strategy"])
    return df.select("strategy", "timestamp", rounded("peak", 4).alias("peak"), rounded("drawdown").alias("drawdown"))


@query(
    "cumulative_return",
    f"""WITH {RET} SELECT strategy, "timestamp", {rnd(f'product(1 + coalesce(r, 0)) OVER ({_BY} ROWS UNBOUNDED PRECEDING)')} AS cumulative FROM ret""",
)
def cumulative_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_returns(strategy_equity(spark, sf_dir), ["strategy"])
    df = pf.with_cumulative_return(df, ["strategy"])
    return df.select("strategy", "timestamp", rounded("cumulative").alias("cumulative"))


_F20 = f"({_BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_sharpe",
    f"""WITH {RET} SELECT strategy, "timestamp", {rnd(f'CASE WHEN count(r) OVER {_F20} = 20 THEN stddev_samp(r) OVER {_F20} * sqrt(252) END')} AS rolling_volatility,
    {rnd(f'CASE WHEN count(r) OVER {_F20} = 20 THEN avg(r) OVER {_F20} / nullif(stddev_samp(r) OVER {_F20}, 0) * sqrt(252) END')} AS rolling_sharpe FROM ret""",
)
def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_returns(strategy_equity(spark, sf_dir), ["strategy"])
    df = pf.with_rolling_risk(df, ["strategy"])
    return r6(df, "rolling_volatility", "rolling_sharpe").select("strategy", "timestamp", "rolling_volatility", "rolling_sharpe")


_EX = "((mean_return - 0.02 / 252) * sqrt(252))"


@query(
    "performance_summary",
    f"""WITH {RET}, s AS (SELECT strategy, arg_min(portfolio_value, "timestamp") AS initial_value, arg_max(portfolio_value, "timestamp") AS final_value,
      date_diff('day', min("timestamp"), max("timestamp")) AS days, count(r) AS periods, avg(r) AS mean_return, coalesce(stddev_samp(r) * sqrt(252), 0) AS volatility,
      coalesce(stddev_samp(r) FILTER (r < 0) * sqrt(252), 0) AS downside_deviation, min(d) AS max_drawdown, count(*) FILTER (d < 0) AS drawdown_periods FROM dd GROUP BY 1),
    t AS (SELECT *, final_value / nullif(initial_value, 0) - 1 AS total_return FROM s),
    a AS (SELECT *, pow(1 + total_return, 365.0 / days) - 1 AS annualized_return FROM t)
    SELECT strategy, initial_value, final_value, days, periods, {rnd('mean_return', 8)} AS mean_return, {rnd('volatility')} AS volatility,
      {rnd('downside_deviation')} AS downside_deviation, {rnd('max_drawdown')} AS max_drawdown, drawdown_periods, {rnd('total_return')} AS total_return,
      {rnd('annualized_return')} AS annualized_return, {rnd(f'coalesce({_EX} / nullif(volatility, 0), 0)')} AS sharpe_ratio,
      {rnd(f'coalesce({_EX} / nullif(downside_deviation, 0), 0)')} AS sortino_ratio, {rnd('coalesce(annualized_return / nullif(abs(max_drawdown), 0), 0)')} AS calmar_ratio FROM a""",
)
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.performance_summary(strategy_equity(spark, sf_dir), ["strategy"])
    return r6(
        r6(df, "mean_return", places=8), "volatility", "downside_deviation", "max_drawdown", "total_return",
        "annualized_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio",
    )


@query(
    "tail_risk",
    f"""WITH {RET}, q AS (SELECT strategy, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.01) AS q01 FROM dd GROUP BY 1)
    SELECT strategy, {rnd('any_value(q05)', 8)} AS var_95, {rnd('any_value(q01)', 8)} AS var_99, {rnd('avg(r) FILTER (r <= q05)', 8)} AS cvar_95,
    {rnd('avg(r) FILTER (r <= q01)', 8)} AS cvar_99, {rnd('sqrt(avg(d * d))')} AS ulcer_index, {rnd('sum(r) / nullif(abs(sum(r) FILTER (r < 0)), 0)')} AS gain_to_pain
    FROM dd JOIN q USING (strategy) GROUP BY 1""",
)
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_drawdown(pf.with_returns(strategy_equity(spark, sf_dir), ["strategy"]), ["strategy"])
    limits = quantiles(df, ["strategy"], "returns", [0.05, 0.01])
    out = pf.tail_risk(df, ["strategy"], limits)
    return r6(r6(out, "var_95", "var_99", "cvar_95", "cvar_99", places=8), "ulcer_index", "gain_to_pain")


@query(
    "benchmark_risk",
    f"""WITH {RET}, p AS (SELECT a.strategy, CASE WHEN b.r IS NOT NULL THEN a.r END AS r, CASE WHEN a.r IS NOT NULL THEN b.r END AS b FROM ret a JOIN ret b
      ON a."timestamp" = b."timestamp" AND b.strategy = '1-URGENT' WHERE a.strategy <> '1-URGENT'),
    s AS (SELECT strategy, covar_samp(r, b) / nullif(var_samp(b), 0) AS beta, avg(r) AS mr, avg(b) AS mb, avg(r - b) AS act, stddev_samp(r - b) AS trk FROM p GROUP BY 1)
    SELECT strategy, {rnd('beta')} AS beta, {rnd('(mr - 0.02 / 252 - beta * (mb - 0.02 / 252)) * 252')} AS alpha, {rnd('act / nullif(trk, 0) * sqrt(252)')} AS information_ratio,
    {rnd('(mr - 0.02 / 252) * 252 / nullif(beta, 0)', 3)} AS treynor_ratio FROM s""",
)
def benchmark_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.with_returns(strategy_equity(spark, sf_dir), ["strategy"])
    lead = df.where(F.col("strategy") == "1-URGENT").select("timestamp", F.col("returns").alias("benchmark_returns"))
    pairs = df.where(F.col("strategy") != "1-URGENT").join(lead, "timestamp")
    out = pf.benchmark_risk(pairs, ["strategy"])
    return r6(r6(out, "beta", "alpha", "information_ratio"), "treynor_ratio", places=3)


@query(
    "round_trip_fields",
    f"""WITH {TRADES} SELECT trade_id, {rnd("date_diff('second', entry_time, exit_time) / 3600.0")} AS holding_hours,
    {rnd("CASE WHEN side = 'SHORT' THEN -1 ELSE 1 END * (exit_price - entry_price) / nullif(entry_price, 0) * 100", 8)} AS pnl_pct FROM trades""",
)
def round_trip_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.round_trip_fields(trades(spark, sf_dir))
    return df.select("trade_id", rounded("holding_hours").alias("holding_hours"), rounded("pnl_pct", 8).alias("pnl_pct"))


@query(
    "trade_summary",
    f"""WITH {TRADES} SELECT strategy, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades,
    count(*) FILTER (pnl = 0) AS break_even_trades, {rnd('sum(pnl)', 4)} AS total_pnl, {rnd('avg(pnl)')} AS average_pnl, {rnd('stddev_pop(pnl)')} AS pnl_std,
    max(pnl) AS best_trade, min(pnl) AS worst_trade, {rnd('coalesce(avg(pnl) FILTER (pnl > 0), 0)')} AS average_win,
    {rnd('coalesce(avg(pnl) FILTER (pnl < 0), 0)')} AS average_loss, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM trades GROUP BY 1""",
)
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.trade_summary(trades(spark, sf_dir), ["strategy"])
    return r6(r6(df, "average_pnl", "pnl_std", "average_win", "average_loss"), "total_pnl", places=4).drop("strategies")


@query(
    "monthly_pnl",
    f"""WITH {TRADES} SELECT strftime(exit_time, '%Y-%m') AS month, {rnd('sum(pnl)', 4)} AS pnl_sum, round(avg(pnl), 4) AS pnl_mean, count(pnl) AS pnl_count FROM trades GROUP BY 1""",
)
def monthly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.monthly_pnl(trades(spark, sf_dir))


_CLOSED = "CASE WHEN action = 'sell' THEN pnl END"


def _stats_sql(pick: str) -> str:
    return f"""WITH {LEGS}, c AS (SELECT *, {_CLOSED} AS x FROM legs) SELECT symbol, count(*) FILTER (action = 'buy') AS buys, count(*) FILTER (action = 'sell') AS sells,
    count(*) FILTER (x > 0) AS wins, count(*) FILTER (x < 0) AS losses, {rnd('coalesce(count(*) FILTER (x > 0) / nullif(count(x), 0), 0)')} AS win_rate,
    {rnd('coalesce(avg(x) FILTER (x > 0), 0)')} AS average_win, {rnd('coalesce(abs(avg(x) FILTER (x < 0)), 0)')} AS average_loss,
    {rnd(f'coalesce({pick}(x) FILTER (x > 0) / nullif(abs({pick}(x) FILTER (x < 0)), 0), 0)')} AS profit_factor FROM c GROUP BY 1"""


@query("trade_stats", _stats_sql("sum"))
def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(pf.trade_statistics(legs(spark, sf_dir), ["symbol"]), "win_rate", "average_win", "average_loss", "profit_factor")


@query("trade_stats_avg", _stats_sql("avg"))
def trade_stats_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.trade_statistics(legs(spark, sf_dir), ["symbol"], "avg")
    return r6(df, "win_rate", "average_win", "average_loss", "profit_factor")


@query(
    "ledger_totals",
    f"""WITH {LEGS}, c AS (SELECT *, {_CLOSED} AS x FROM legs) SELECT run_id, {rnd('coalesce(sum(x), 0)', 4)} AS total_pnl, {rnd('100000.0 + coalesce(sum(x), 0)', 4)} AS final_value,
    {rnd('coalesce(sum(x), 0) / 100000.0')} AS total_return, count(x) AS closed_trades, count(*) AS legs, count(*) FILTER (x > 0) AS winning_trades,
    {rnd('coalesce(count(*) FILTER (x > 0) / nullif(count(x), 0), 0)')} AS win_rate, {rnd('count(*) FILTER (x > 0) / count(*)')} AS win_rate_by_leg FROM c GROUP BY 1""",
)
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pf.ledger_totals(legs(spark, sf_dir), ["run_id"], 100_000.0)
    return r6(r6(df, "total_pnl", "final_value", places=4), "total_return", "win_rate", "win_rate_by_leg")


@query(
    "kelly_fraction",
    f"""WITH {LEGS}, c AS (SELECT *, {_CLOSED} AS x FROM legs), w AS (SELECT run_id, coalesce(count(*) FILTER (x > 0) / nullif(count(x), 0), 0) AS w FROM c GROUP BY 1)
    SELECT run_id, {rnd('greatest(least((w * 0.02 - (1 - w) * 0.01) / 0.02, 0.05), 0.0)')} AS kelly FROM w""",
)
def kelly_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pf.trade_statistics(legs(spark, sf_dir), ["run_id"])
    return stats.select("run_id", rounded(td.kelly_fraction(F.col("win_rate"))).alias("kelly"))


@query(
    "portfolio_ratios",
    f"""WITH s AS (SELECT c_custkey, any_value(c_acctbal) AS total_equity, sum(o_totalprice) AS total_exposure FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_custkey, {rnd('total_exposure / nullif(total_equity, 0)', 5)} AS leverage, {rnd('total_equity / nullif(total_exposure * 0.1, 0)', 8)} AS margin_level FROM s""",
)
def portfolio_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exposure is reduced to one row per customer before the join.
    exposure = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total_exposure"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("total_equity"))
    states = customers.join(exposure, customers.c_custkey == exposure.o_custkey).withColumn("margin_used", F.col("total_exposure") * 0.1)
    return pf.portfolio_ratios(states).select(
        "c_custkey", rounded("leverage", 5).alias("leverage"), rounded("margin_level", 8).alias("margin_level")
    )


@query(
    "validate_results",
    f"""WITH {LEGS}, s AS (SELECT run_id, min("timestamp") AS a, max("timestamp") AS b, count(*) AS n, count(*) FILTER (pnl <> 0) AS m, sum(pnl) / 1000.0 AS r FROM legs GROUP BY 1)
    SELECT run_id, array_to_string(list_filter([CASE WHEN a >= b THEN 'Start date must be before end date' END,
      CASE WHEN n <> m THEN 'Trade count mismatch between metrics and trade records' END], lambda x: x IS NOT NULL), '; ') AS errors,
    array_to_string(list_filter([CASE WHEN m = 0 THEN 'No trades recorded in backtest' END, CASE WHEN abs(r) > 10 THEN 'Extremely high total return - verify calculations' END,
      CASE WHEN abs(r) / 100 > 1 THEN 'Maximum drawdown exceeds 100% - verify calculations' END], lambda x: x IS NOT NULL), '; ') AS warnings,
    NOT (a >= b OR n <> m) AS valid FROM s""",
)
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = legs(spark, sf_dir).groupBy("run_id").agg(
        F.min("timestamp").alias("start_date"),
        F.max("timestamp").alias("end_date"),
        F.count("*").alias("total_trades"),
        F.count(F.when(F.col("pnl") != 0, 1)).alias("recorded_trades"),
        (F.sum("pnl") / 1000.0).alias("total_return"),
    ).withColumn("max_drawdown", F.abs("total_return") / 100)
    return pf.validate_results(results).select(
        "run_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "valid"
    )


# --- runs ----------------------------------------------------------------------------------------


@query(
    "runs_rollup",
    f"""WITH {RUNS} SELECT count(*) AS total_runs, CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(winning_trades) AS BIGINT) AS winning_trades,
    CAST(sum(losing_trades) AS BIGINT) AS losing_trades, {rnd('avg(hit_rate)')} AS avg_hit_rate, CAST(sum(total_trades - winning_trades - losing_trades) AS BIGINT) AS open_trades
    FROM runs WHERE winning_trades + losing_trades <= total_trades""",
)
def runs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(rn.win_loss_rollup(runs(spark, sf_dir)), "avg_hit_rate")


_EXEC = """SELECT run_id, {0} AS total_slippage, {1} AS average_slippage, {2} AS total_fees,
  CASE WHEN sum(abs(execution_price - price) / nullif(price, 0)) < 0.001 THEN 'high' WHEN sum(abs(execution_price - price) / nullif(price, 0)) < 0.005 THEN 'medium' ELSE 'low' END AS execution_quality
  FROM legs GROUP BY 1""".format(
    rnd("sum(abs(execution_price - price) / nullif(price, 0))"),
    rnd("avg(abs(execution_price - price) / nullif(price, 0))", 9),
    rnd("sum(fees)", 5),
)


@query("execution_quality", f"WITH {LEGS} {_EXEC}")
def execution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rn.execution_quality(legs(spark, sf_dir), ["run_id"])
    return r6(r6(r6(df, "total_slippage"), "average_slippage", places=9), "total_fees", places=5)


@query(
    "trade_timing",
    f"""WITH {TICK_LEGS}, h AS (SELECT symbol, hour(ts) AS hour, count(*) AS n FROM tick_legs GROUP BY 1, 2)
    SELECT symbol, CAST(sum(n) AS BIGINT) AS total_trades, CAST(arg_max(hour, n * 100 - hour) AS BIGINT) AS peak_hour, concat(min(hour), '-', max(hour)) AS trading_hours FROM h GROUP BY 1""",
)
def trade_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.trade_timing(tick_legs(spark, sf_dir), ["symbol"], "ts")


@query(
    "position_concentration",
    f"""WITH {RUNS}, s AS (SELECT symbol, sum(quantity) AS q FROM positions GROUP BY 1)
    SELECT count(*) AS total_symbols, sum(q) AS total_quantity, arg_max(symbol, q) AS most_held FROM s""",
)
def position_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.position_concentration(runs(spark, sf_dir))


@query(
    "portfolio_rollup",
    f"""WITH {RUNS} SELECT CAST(sum(initial_equity) AS DOUBLE) AS initial_equity, {rnd('sum(final_equity)', 4)} AS final_equity, {rnd('sum(final_equity) - sum(initial_equity)', 4)} AS equity_change,
    {rnd('(sum(final_equity) - sum(initial_equity)) / sum(initial_equity) * 100')} AS total_return_pct, {rnd('sum(final_equity) / sum(initial_equity)')} AS equity_efficiency FROM runs""",
)
def portfolio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rn.portfolio_rollup(runs(spark, sf_dir))
    return r6(r6(df, "final_equity", "equity_change", places=4), "total_return_pct", "equity_efficiency")


@query(
    "run_artifacts",
    f"""WITH {RUNS}, {RUN_EQ}, {LEGS}, e AS (SELECT run_key, max(portfolio_value) AS max_value, min(portfolio_value) AS min_value, {rnd('stddev_samp(portfolio_value)', 3)} AS volatility FROM equity GROUP BY 1),
    l AS (SELECT run_id, count(*) AS legs, {rnd('sum(fees)', 5)} AS fees FROM legs GROUP BY 1)
    SELECT runs.run_id, runs.total_trades, max_value, min_value, volatility, legs, fees FROM runs LEFT JOIN e ON runs.run_key = e.run_key LEFT JOIN l ON runs.run_id = l.run_id""",
)
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = equity_by(spark, sf_dir, "run_key").withColumn("run_id", run_id(F.col("run_key"))).drop("run_key")
    df = rn.join_artifacts(runs(spark, sf_dir), curve, legs(spark, sf_dir))
    return r6(r6(df, "volatility", places=3), "fees", places=5).select(
        "run_id", "total_trades", "max_value", "min_value", "volatility", "legs", "fees"
    )


@query(
    "run_patterns",
    f"""WITH {RUNS} SELECT arg_max(run_id, total_return_pct) AS best_run, arg_min(run_id, total_return_pct) AS worst_run, round(avg(sharpe_ratio), 3) AS avg_sharpe,
    round(avg(max_drawdown), 2) AS avg_drawdown, round(sum(total_return_pct), 2) AS total_pnl_pct,
    CASE WHEN round(avg(sharpe_ratio), 3) > 1 THEN 'low' WHEN round(avg(sharpe_ratio), 3) < 0.5 THEN 'high' ELSE 'medium' END AS risk_level FROM runs""",
)
def run_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.run_patterns(runs(spark, sf_dir))


def _run_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = rn.execution_quality(legs(spark, sf_dir), ["run_id"]).select("run_id", "execution_quality")
    stats = runs(spark, sf_dir).join(quality, "run_id").withColumns(
        {
            "open_trades": F.col("total_trades") - F.col("winning_trades") - F.col("losing_trades"),
            "total_symbols": F.coalesce(F.size("final_positions"), F.lit(0)),
            "seq": F.col("run_key"),
        }
    )
    return rn.with_insights(stats)


_P, _L = rn.PATTERN_TEXTS, rn.LESSON_TEXTS
_INSIGHTS = f"""{RUNS}, {LEGS}, xq AS ({_EXEC}), ps AS (SELECT run_key, count(*) AS total_symbols FROM positions GROUP BY 1),
st AS (SELECT runs.run_id, runs.run_key AS seq, hit_rate, total_trades, total_trades - winning_trades - losing_trades AS open_trades,
  coalesce(total_symbols, 0) AS total_symbols, execution_quality FROM runs JOIN xq USING (run_id) LEFT JOIN ps ON runs.run_key = ps.run_key),
ins AS (SELECT *, list_filter([CASE WHEN hit_rate < 0.2 THEN '{_P['failing']}' WHEN hit_rate < 0.4 THEN '{_P['weak']}' WHEN hit_rate > 0.6 THEN '{_P['strong']}' END,
  CASE WHEN open_trades > total_trades * 0.7 THEN '{_P['open_high']}' WHEN open_trades > total_trades * 0.5 THEN '{_P['open_some']}' END,
  CASE WHEN total_symbols > 10 THEN '{_P['many_symbols']}' WHEN total_symbols < 3 THEN '{_P['few_symbols']}' END], lambda x: x IS NOT NULL) AS key_patterns,
  list_filter([CASE WHEN hit_rate < 0.3 THEN '{_L['revise']}' WHEN hit_rate < 0.5 THEN '{_L['refine']}' END, CASE WHEN open_trades > total_trades * 0.5 THEN '{_L['exits']}' END,
  CASE WHEN total_symbols > 8 THEN '{_L['focus']}' END, CASE WHEN execution_quality = 'low' THEN '{_L['execution']}' END,
  CASE WHEN total_trades > 50 THEN '{_L['plenty']}' WHEN total_trades > 20 THEN '{_L['some']}' ELSE '{_L['little']}' END], lambda x: x IS NOT NULL) AS lessons FROM st)"""


@query(
    "run_insights",
    f"WITH {_INSIGHTS} SELECT run_id, array_to_string(key_patterns, '; ') AS key_patterns, array_to_string(lessons, '; ') AS lessons FROM ins",
)
def run_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_insights(spark, sf_dir).select(
        "run_id", F.array_join("key_patterns", "; ").alias("key_patterns"), F.array_join("lessons", "; ").alias("lessons")
    )


@query(
    "insight_digest",
    f"""WITH {_INSIGHTS}, last5 AS (SELECT * FROM ins ORDER BY seq DESC LIMIT 5), last10 AS (SELECT * FROM ins ORDER BY seq DESC LIMIT 10),
    pat AS (SELECT p, min(seq * 100 + i) AS o FROM (SELECT seq, unnest(key_patterns) AS p, generate_subscripts(key_patterns, 1) AS i FROM last5) GROUP BY 1),
    les AS (SELECT p, min(seq * 100 + i) AS o FROM (SELECT seq, unnest(lessons) AS p, generate_subscripts(lessons, 1) AS i FROM last5) GROUP BY 1)
    SELECT (SELECT count(*) FROM ins) AS total_insights, coalesce((SELECT string_agg(p, '; ' ORDER BY o) FROM (SELECT * FROM pat ORDER BY o LIMIT 3)), '') AS key_patterns,
    coalesce((SELECT string_agg(p, '; ' ORDER BY o) FROM (SELECT * FROM les ORDER BY o LIMIT 2)), '') AS lessons, {rnd('avg(hit_rate)')} AS avg_hit_rate,
    CASE WHEN count(*) > 1 AND arg_max(hit_rate, seq) > arg_min(hit_rate, seq) THEN 'improving' ELSE 'stable' END AS trend FROM last10""",
)
def insight_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rn.insight_digest(_run_insights(spark, sf_dir))
    return r6(df, "avg_hit_rate").withColumns(
        {"key_patterns": F.array_join("key_patterns", "; "), "lessons": F.array_join("lessons", "; ")}
    )


@query(
    "runs_ranked",
    f"WITH {RUNS} SELECT run_id, {rnd('total_return_pct')} AS total_return_pct, total_trades FROM runs ORDER BY total_return_pct DESC, run_id LIMIT 10",
)
def runs_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(rn.rank_runs(runs(spark, sf_dir), 10), "total_return_pct").select("run_id", "total_return_pct", "total_trades")


@query(
    "latest_runs",
    f"WITH {RUNS} SELECT run_id, finished_at, total_trades FROM runs ORDER BY finished_at DESC, run_id DESC LIMIT 5",
)
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.latest(runs(spark, sf_dir), ["finished_at", "run_id"], 5).select("run_id", "finished_at", "total_trades")


@query(
    "latest_legs_per_symbol",
    f"""WITH {TICK_LEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn FROM tick_legs)
    SELECT symbol, ts, event_id, action, quantity, price FROM r WHERE rn <= 3""",
)
def latest_legs_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.latest(tick_legs(spark, sf_dir), ["ts", "event_id"], 3, ["symbol"])


@query(
    "run_outcomes",
    f"""WITH {RUNS} SELECT count(*) AS runs, count(*) FILTER (total_return_pct > 0) AS profitable, count(*) FILTER (total_return_pct < 0) AS losing,
    count(*) FILTER (total_return_pct = 0) AS flat FROM runs""",
)
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.outcome_counts(runs(spark, sf_dir))
