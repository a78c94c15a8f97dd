"""Trade outcomes, ledgers, positions, equity and parameter grids as relational queries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import CostModel, ParameterGrid, TradeConfig
from tickloom.functions.numeric import clip, count_if, ratio
from tickloom.plans.breach import first_breaches
from tickloom.plans.scan import running
from tickloom.plans.small import join_small
from tickloom.session import durable


def trade_cost(value: Column, cfg: TradeConfig | None = None) -> Column:
    """Commission plus slippage on a traded value."""
    cfg = cfg or TradeConfig()
    return value * (cfg.commission_rate + cfg.slippage_bps / 10_000)


def venue_cost(value: Column, model: CostModel | None = None, maker: bool = False) -> Column:
    """Fee, slippage and size-dependent impact (capped), with the safety buffer."""
    m = model or CostModel()
    fee = m.maker_fee_bps if maker else m.taker_fee_bps
    slippage = min(m.slippage_bps, m.max_slippage_bps)
    impact = F.least(m.impact_bps_per_block * value / m.impact_block_usd, F.lit(m.max_impact_bps))
    return value * (fee + slippage + impact) / 10_000 * (1 + m.buffer_pct)


def kelly_fraction(
    win_rate: Column, average_win: float = 0.02, average_loss: float = 0.01, ceiling: float = 0.05
) -> Column:
    """Kelly fraction clamped to [0, ceiling]."""
    raw = (win_rate * average_win - (1 - win_rate) * average_loss) / average_win
    return clip(raw, F.lit(0.0), F.lit(ceiling))


def _instant(micros: Column, kind: str) -> Column:
    return F.timestamp_micros(micros).cast(kind)


def barrier_outcomes(
    labelled: DataFrame, cfg: TradeConfig | None = None, *, rows_per_slice: int | None = None
) -> DataFrame:
    """For each buy: the first later bar that hits the stop, the target or a sell.

    However far away it is; on one bar the stop is tested before the target and
    the target before the signal. Exits are at the close; a buy without one is ``open``.
    """
    cfg = cfg or TradeConfig()
    found = first_breaches(labelled, [cfg.stop_loss_pct], [cfg.take_profit_pct], rows_per_slice=rows_per_slice)
    kind = dict(labelled.dtypes)["ts"]
    low, high = F.col("close") * (1 - cfg.stop_loss_pct), F.col("close") * (1 + cfg.take_profit_pct)
    # Structs compare by time first.
    found = found.withColumn("_exit", F.array_min(F.array_compact("marks")))
    price = F.col("_exit.close")
    reason = (
        F.when(price.isNull(), "open")
        .when(price <= low, "stop_loss")
        .when(price >= high, "take_profit")
        .otherwise("signal")
    )
    return found.select(
        "symbol",
        _instant(F.col("ts"), kind).alias("entry_time"),
        F.col("close").alias("entry_price"),
        _instant(F.col("_exit.ts"), kind).alias("exit_time"),
        price.alias("exit_price"),
        reason.alias("exit_reason"),
    )


def first_round_trip(labelled: DataFrame, cfg: TradeConfig | None = None) -> DataFrame:
    """Each symbol's first buy and its exit, with no horizon.

    Two aggregations with map-side combine: the entry per symbol, then the
    earliest bar after it that ends the trade.
    """
    cfg = cfg or TradeConfig()
    bars = labelled.select("symbol", "ts", "close", "signal")
    entry = bars.where(F.col("signal") == "buy").groupBy("symbol").agg(
        F.min("ts").alias("entry_time"), F.min_by("close", "ts").alias("entry_price")
    )
    low = F.col("entry_price") * (1 - cfg.stop_loss_pct)
    high = F.col("entry_price") * (1 + cfg.take_profit_pct)
    later = join_small(bars, entry, ["symbol"], "inner").where(
        (F.col("ts") > F.col("entry_time"))
        & ((F.col("close") <= low) | (F.col("close") >= high) | (F.col("signal") == "sell"))
    )
    exits = later.groupBy("symbol").agg(
        F.min("ts").alias("exit_time"), F.min_by("close", "ts").alias("exit_price")
    )
    reason = (
        F.when(F.col("exit_price").isNull(), "open")
        .when(F.col("exit_price") <= low, "stop_loss")
        .when(F.col("exit_price") >= high, "take_profit")
        .otherwise("signal")
    )
    return entry.join(exits, "symbol", "left").withColumn("exit_reason", reason)


def trade_ledger(trips: DataFrame, cfg: TradeConfig | None = None) -> DataFrame:
    """Buy and sell legs of fixed-fraction trips; the buy cost hits cash, not P&L."""
    cfg = cfg or TradeConfig()
    notional = cfg.initial_capital * cfg.max_position_size
    quantity = ratio(F.lit(notional), F.col("entry_price"))
    sized = trips.withColumns({"quantity": quantity, "_buy_cost": trade_cost(F.lit(notional), cfg)})
    sell_value = F.col("quantity") * F.col("exit_price")
    sell_cost = trade_cost(sell_value, cfg)
    leg = lambda ts, action, price, cost, pnl, cash: F.struct(
        ts.alias("timestamp"), F.lit(action).alias("action"), price.alias("price"),
        cost.alias("costs"), pnl.alias("pnl"), cash.alias("cash_flow"),
    )
    buy = leg(
        F.col("entry_time"), "buy", F.col("entry_price"), F.col("_buy_cost"), F.lit(0.0),
        -(F.lit(notional) + F.col("_buy_cost")),
    )
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") - sell_cost
    sell = leg(
        F.col("exit_time"), "sell", F.col("exit_price"), sell_cost, pnl, sell_value - sell_cost
    )
    legs = F.array_compact(F.array(buy, F.when(F.col("exit_time").isNotNull(), sell)))
    return sized.select("symbol", "quantity", F.explode(legs).alias("l")).select(
        "symbol", "l.timestamp", "l.action", "quantity", "l.price", "l.costs", "l.pnl", "l.cash_flow"
    )


def grid_rank(
    labelled: DataFrame,
    grid: ParameterGrid | None = None,
    cfg: TradeConfig | None = None,
    *,
    periods: float = 1440.0,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Every stop x target x size combination, ranked by total return, in one job.

    The first bar past each stop and each target is found once per entry, at any
    distance. A stop x target pair only compares those bars; its gains are summed per exit
    time before anything is multiplied by the grid, and the sizes scale the sums.
    The equity of a combination moves at its exit times: ``max_drawdown`` is its lowest
    distance from the peak so far, ``sharpe_ratio`` the mean over the deviation of its
    moves, scaled to ``periods`` (0 where undefined).
    """
    grid, cfg = grid or ParameterGrid(), cfg or TradeConfig()
    stops, targets = list(grid.stop_loss_pct), list(grid.take_profit_pct)
    entries = first_breaches(labelled, stops, targets, rows_per_slice=rows_per_slice)
    cost = cfg.commission_rate + cfg.slippage_bps / 10_000
    sell = F.get("marks", F.lit(len(stops) + len(targets)))
    cells = []
    for i, stop in enumerate(stops):
        for j, target in enumerate(targets):
            at = F.array_min(F.array_compact(F.array(F.get("marks", F.lit(i)), F.get("marks", F.lit(len(stops) + j)), sell)))
            growth = at["close"] / F.col("close")
            # Per unit of invested notional: price change less the exit cost.
            cells.append(
                F.struct(
                    F.lit(stop).alias("stop_loss_pct"), F.lit(target).alias("take_profit_pct"),
                    at["ts"].alias("at"), (growth - 1 - growth * cost).alias("gain"),
                )
            )
    pair = ["stop_loss_pct", "take_profit_pct"]
    moves = (
        entries.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        .groupBy(*pair, "at")
        .agg(F.count("*").alias("entries"), F.count("gain").alias("closed"), count_if(F.col("gain") > 0).alias("wins"), F.sum("gain").alias("gain"))
    )
    moves = durable(moves)
    totals = moves.groupBy(*pair).agg(
        F.sum("entries").alias("entries"), F.sum("closed").alias("closed_trades"), F.sum("wins").alias("_wins"),
        F.coalesce(F.sum("gain"), F.lit(0.0)).alias("_gain"),
    )
    summed = running(moves.where(F.col("gain").isNotNull()), pair, ["at"], {"_sum": ("sum", F.col("gain"))}, rows_per_slice=rows_per_slice)
    peaked = running(durable(summed), pair, ["at"], {"_peak": ("max", F.col("_sum"))}, rows_per_slice=rows_per_slice)
    sizes = F.explode(F.array(*(F.lit(x) for x in grid.max_position_size))).alias("max_position_size")
    size, peak = F.col("max_position_size"), F.greatest(F.col("_peak"), F.lit(0.0))
    path = peaked.select(*pair, "gain", "_sum", "_peak", sizes).groupBy(*pair, "max_position_size").agg(
        F.min(size * (F.col("_sum") - peak) / (1 + size * peak)).alias("max_drawdown"),
        F.avg(size * F.col("gain") / (1 + size * (F.col("_sum") - F.col("gain")))).alias("_mean"),
        F.stddev(size * F.col("gain") / (1 + size * (F.col("_sum") - F.col("gain")))).alias("_std"),
    )
    return (
        totals.select("*", sizes).join(path, [*pair, "max_position_size"], "left")
        .withColumns({
            "win_rate": F.coalesce(ratio(F.col("_wins"), F.col("closed_trades")), F.lit(0.0)),
            "total_return": F.col("_gain") * size,
            "max_drawdown": F.coalesce("max_drawdown", F.lit(0.0)),
            "sharpe_ratio": F.coalesce(ratio(F.col("_mean"), F.col("_std")) * math.sqrt(periods), F.lit(0.0)),
        })
        .withColumn("final_equity", cfg.initial_capital * (1 + F.col("total_return")))
        .drop("_gain", "_wins", "_mean", "_std")
        .orderBy(F.desc("total_return"), "stop_loss_pct", "take_profit_pct", "max_position_size")
    )


def signed_quantity(action: str = "action", quantity: str = "quantity") -> Column:
    return F.when(F.col(action) == "buy", F.col(quantity)).otherwise(-F.col(quantity))


def open_positions(legs: DataFrame) -> DataFrame:
    """Net quantity per symbol, closed ones dropped (assumes no over-selling)."""
    return (
        legs.groupBy("symbol").agg(F.sum(signed_quantity()).alias("quantity")).where(F.col("quantity") > 0)
    )


def open_positions_ordered(
    legs: DataFrame, order: Sequence[str] = ("ts",), *, rows_per_slice: int | None = None
) -> DataFrame:
    """Net quantity where a position never goes below zero.

    Flooring a running sum at zero equals the sum minus its running minimum
    (bounded by zero), so no sequential pass is needed.
    """
    net = running(
        legs.withColumn("_q", signed_quantity()), ["symbol"], order,
        {"_sum": ("sum", F.col("_q"))}, rows_per_slice=rows_per_slice,
    )
    totals = net.groupBy("symbol").agg(F.sum("_q").alias("total"), F.min("_sum").alias("lowest"))
    held = F.col("total") - F.least(F.col("lowest"), F.lit(0.0))
    return totals.select("symbol", held.alias("quantity")).where(F.col("quantity") > 0)


def position_asof(
    bars: DataFrame, legs: DataFrame, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Quantity held at each bar: signed legs up to and including its ``ts``.

    Legs are summed per (symbol, ts) and merged with the bars, so the as-of
    lookup is one running sum over the union instead of a range join.
    """
    moves = legs.groupBy("symbol", "ts").agg(F.sum(signed_quantity()).alias("_q"))
    marks = bars.select("symbol", "ts", F.col("close").alias("_close"), F.lit(0.0).alias("_q"), F.lit(True).alias("_bar"))
    events = marks.unionByName(
        moves.select("symbol", "ts", F.lit(None).cast("double").alias("_close"), "_q", F.lit(False).alias("_bar"))
    )
    # Legs sort before the bar of the same instant.
    held = running(
        events, ["symbol"], ["ts", "_bar"], {"quantity": ("sum", F.col("_q"))}, rows_per_slice=rows_per_slice
    )
    return held.where("_bar").select("symbol", "ts", F.col("_close").alias("close"), "quantity")


def position_value(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions valued at the bar of the same (symbol, ts); 0 without a bar."""
    priced = positions.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return priced.withColumn("value", F.coalesce(F.col("quantity") * F.col("close"), F.lit(0.0)))


def equity_curve(
    bars: DataFrame,
    legs: DataFrame,
    initial_capital: float = 100_000.0,
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Cash plus the value of held positions at every bar time.

    ``legs``: symbol, ts, action, quantity, cash_flow.
    """
    held = position_asof(bars, legs, rows_per_slice=rows_per_slice)
    values = held.groupBy("ts").agg(
        F.sum(F.when(F.col("quantity") > 0, F.col("quantity") * F.col("close")).otherwise(0.0)).alias("positions_value")
    )
    flows = legs.groupBy("ts").agg(F.sum("cash_flow").alias("_flow"))
    events = values.withColumns({"_flow": F.lit(0.0), "_mark": F.lit(True)}).unionByName(
        flows.withColumns({"positions_value": F.lit(None).cast("double"), "_mark": F.lit(False)})
    )
    # One account: a single series, scanned in slices when it is long.
    cash = running(
        events.withColumn("_account", F.lit(1)), ["_account"], ["ts", "_mark"],
        {"_spent": ("sum", F.col("_flow"))}, rows_per_slice=rows_per_slice,
    )
    out = cash.where("_mark").withColumn("cash", initial_capital + F.col("_spent"))
    return out.select(
        F.col("ts").alias("timestamp"),
        (F.col("cash") + F.col("positions_value")).alias("portfolio_value"),
        "cash",
        "positions_value",
    )
