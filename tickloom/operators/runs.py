"""Analytics over many runs: roll-ups, execution quality, insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import count_if, ratio


def consistent(runs: DataFrame) -> DataFrame:
    """Runs whose win and loss counts fit their trade count."""
    total, won, lost = (F.col(c) for c in ("total_trades", "winning_trades", "losing_trades"))
    sane = (total >= 0) & (won >= 0) & (lost >= 0)
    return runs.where(sane & F.when(total == 0, (won == 0) & (lost == 0)).otherwise(won + lost <= total))


def win_loss_rollup(runs: DataFrame) -> DataFrame:
    """Totals over consistent runs, average hit rate, open trades."""
    kept = consistent(runs)
    hit = F.coalesce(ratio("winning_trades", "total_trades"), F.lit(0.0))
    still_open = F.col("total_trades") - F.col("winning_trades") - F.col("losing_trades")
    return kept.agg(
        F.count("*").alias("total_runs"),
        F.coalesce(F.sum("total_trades"), F.lit(0)).alias("total_trades"),
        F.coalesce(F.sum("winning_trades"), F.lit(0)).alias("winning_trades"),
        F.coalesce(F.sum("losing_trades"), F.lit(0)).alias("losing_trades"),
        F.avg(hit).alias("avg_hit_rate"),
        F.coalesce(F.sum(still_open), F.lit(0)).alias("open_trades"),
    )


def execution_quality(legs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slippage (total and per leg), fees and the quality bucket of the total."""
    slippage = ratio(F.abs(F.col("execution_price") - F.col("price")), F.col("price"))
    total = F.coalesce(F.sum(slippage), F.lit(0.0))
    return legs.groupBy(*by).agg(
        total.alias("total_slippage"),
        F.avg(slippage).alias("average_slippage"),
        F.sum("fees").alias("total_fees"),
    ).withColumn(
        "execution_quality",
        F.when(F.col("total_slippage") < 0.001, "high")
        .when(F.col("total_slippage") < 0.005, "medium")
        .otherwise("low"),
    )


def trade_timing(legs: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Count, busiest hour (smallest on ties) and trading-hour range."""
    hours = legs.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy(*by).agg(
        F.sum("n").alias("total_trades"),
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"),
        F.concat_ws("-", F.min("hour"), F.max("hour")).alias("trading_hours"),
    )


def held_quantities(runs: DataFrame) -> DataFrame:
    """Quantity per symbol over every run's final positions."""
    return (
        runs.select(F.explode("final_positions").alias("symbol", "q"))
        .groupBy("symbol")
        .agg(F.sum("q").alias("quantity"))
    )


def position_concentration(runs: DataFrame) -> DataFrame:
    """Distinct symbols held and the most held one (smallest name on ties)."""
    ranked = held_quantities(runs).orderBy(F.desc("quantity"), "symbol").limit(1)
    totals = held_quantities(runs).agg(F.count("*").alias("total_symbols"), F.sum("quantity").alias("total_quantity"))
    one = F.lit(1).alias("_one")
    return (
        totals.select("*", one)
        .join(ranked.select(F.col("symbol").alias("most_held"), one), "_one", "left")
        .drop("_one")
    )


def portfolio_rollup(runs: DataFrame) -> DataFrame:
    """Summed equity over runs, return and efficiency."""
    first, last = F.sum("initial_equity"), F.sum("final_equity")
    return runs.agg(
        first.alias("initial_equity"),
        last.alias("final_equity"),
        (last - first).alias("equity_change"),
        (ratio(last - first, first) * 100).alias("total_return_pct"),
        ratio(last, first).alias("equity_efficiency"),
    )


def equity_evolution(equity: DataFrame) -> DataFrame:
    """Maximum, minimum and deviation of the portfolio value per run."""
    return equity.groupBy("run_id").agg(
        F.max("portfolio_value").alias("max_value"),
        F.min("portfolio_value").alias("min_value"),
        F.stddev_samp("portfolio_value").alias("volatility"),
    )


def join_artifacts(runs: DataFrame, equity: DataFrame, legs: DataFrame) -> DataFrame:
    """Run metrics next to their equity range and leg totals.

    Equity and legs are reduced to one row per run before the joins.
    """
    traded = legs.groupBy("run_id").agg(F.count("*").alias("legs"), F.sum("fees").alias("fees"))
    return runs.join(equity_evolution(equity), "run_id", "left").join(traded, "run_id", "left")


def run_patterns(runs: DataFrame) -> DataFrame:
    """Best and worst run, average Sharpe and drawdown, summed return, risk level.

    On equal returns the smallest run id wins.
    """
    stats = runs.agg(
        F.min_by("run_id", F.struct(-F.col("total_return_pct"), F.col("run_id"))).alias("best_run"),
        F.min_by("run_id", F.struct(F.col("total_return_pct"), F.col("run_id"))).alias("worst_run"),
        F.round(F.avg("sharpe_ratio"), 3).alias("avg_sharpe"),
        F.round(F.avg("max_drawdown"), 2).alias("avg_drawdown"),
        F.round(F.sum("total_return_pct"), 2).alias("total_pnl_pct"),
    )
    return stats.withColumn(
        "risk_level",
        F.when(F.col("avg_sharpe") > 1.0, "low").when(F.col("avg_sharpe") < 0.5, "high").otherwise("medium"),
    )


# Fixed report texts.
PATTERN_TEXTS = {
    "failing": "Critical: Extremely low win rate indicates fundamental strategy failure",
    "weak": "Low win rate suggests strategy needs immediate refinement",
    "strong": "Strong win rate indicates effective strategy execution",
    "open_high": "High open position ratio suggests poor exit strategy or over-trading",
    "open_some": "Moderate open position ratio indicates room for improvement in position management",
    "many_symbols": "High symbol diversification may indicate lack of focus",
    "few_symbols": "Low symbol diversification increases concentration risk",
}
LESSON_TEXTS = {
    "revise": "Immediate action required: Review and revise entry/exit criteria",
    "refine": "Strategy refinement needed: Analyze losing trades for common patterns",
    "exits": "Implement strict position management: Set stop-loss and take-profit levels",
    "focus": "Consider reducing symbol count for better focus and management",
    "execution": "Improve execution quality: Review slippage and timing strategies",
    "plenty": "Sufficient data for statistical analysis - patterns are reliable",
    "some": "Moderate data for analysis - continue collecting for better insights",
    "little": "Limited data available - continue trading for better pattern recognition",
}


def with_insights(stats: DataFrame) -> DataFrame:
    """Add ``key_patterns`` and ``lessons`` arrays.

    ``stats``: hit_rate, open_trades, total_trades, total_symbols, execution_quality.
    """
    hit, total = F.col("hit_rate"), F.col("total_trades")
    still_open, symbols = F.col("open_trades"), F.col("total_symbols")
    p, q = PATTERN_TEXTS, LESSON_TEXTS
    patterns: list[Column] = [
        F.when(hit < 0.2, p["failing"]).when(hit < 0.4, p["weak"]).when(hit > 0.6, p["strong"]),
        F.when(still_open > total * 0.7, p["open_high"]).when(still_open > total * 0.5, p["open_some"]),
        F.when(symbols > 10, p["many_symbols"]).when(symbols < 3, p["few_symbols"]),
    ]
    lessons: list[Column] = [
        F.when(hit < 0.3, q["revise"]).when(hit < 0.5, q["refine"]),
        F.when(still_open > total * 0.5, q["exits"]),
        F.when(symbols > 8, q["focus"]),
        F.when(F.col("execution_quality") == "low", q["execution"]),
        F.when(total > 50, q["plenty"]).when(total > 20, q["some"]).otherwise(q["little"]),
    ]
    return stats.withColumns(
        {"key_patterns": F.array_compact(F.array(*patterns)), "lessons": F.array_compact(F.array(*lessons))}
    )


def latest(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows (per group): a top-n, not a full sort."""
    newest = [F.desc(c) for c in order]
    if not by:
        return df.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def insight_digest(
    insights: DataFrame, recent: int = 5, trend: int = 10, patterns: int = 3, lessons: int = 2
) -> DataFrame:
    """Distinct recent patterns and lessons in order, hit-rate mean and trend.

    ``insights``: seq, hit_rate, key_patterns, lessons. Only the last
    ``max(recent, trend)`` insights are gathered.
    """
    tail = latest(insights, ["seq"], max(recent, trend))
    total = insights.agg(F.count("*").alias("total_insights"), F.lit(1).alias("_one"))
    packed = tail.agg(
        F.array_sort(F.collect_list(F.struct("seq", "hit_rate", "key_patterns", "lessons"))).alias("items"),
        F.lit(1).alias("_one"),
    )
    last = lambda n: F.slice("items", -F.least(F.lit(n), F.size("items")), n)
    flat = lambda field, keep: F.slice(F.array_distinct(F.flatten(last(recent)[field])), 1, keep)
    rates = F.filter(last(trend)["hit_rate"], lambda r: r.isNotNull())
    mean = F.aggregate("rates", F.lit(0.0), lambda a, r: a + r) / F.size("rates")
    return (
        total.join(packed, "_one")
        .withColumn("rates", F.when(F.size("items") > 0, rates))
        .select(
            "total_insights",
            F.when(F.size("items") > 0, flat("key_patterns", patterns)).alias("key_patterns"),
            F.when(F.size("items") > 0, flat("lessons", lessons)).alias("lessons"),
            F.when(F.size("rates") > 0, mean).alias("avg_hit_rate"),
            F.when(
                (F.size("rates") > 1) & (F.element_at("rates", -1) > F.get("rates", F.lit(0))), "improving"
            ).otherwise("stable").alias("trend"),
        )
    )


def rank_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs by total return, best first; top ``n`` when given."""
    ranked = runs.orderBy(F.desc_nulls_last("total_return_pct"), "run_id")
    return ranked if n is None else ranked.limit(n)


def outcome_counts(runs: DataFrame) -> DataFrame:
    """Profitable, losing and flat runs."""
    r = F.col("total_return_pct")
    return runs.agg(
        F.count("*").alias("runs"),
        count_if(r > 0).alias("profitable"),
        count_if(r < 0).alias("losing"),
        count_if(r == 0).alias("flat"),
    )
