"""Raw bars to canonical bars: timestamps, rules, quarantine, deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import QualityConfig

OHLCV = ("open", "high", "low", "close", "volume")
CANONICAL = (
    "ts", "symbol", "open", "high", "low", "close", "volume", "spread_est", "source", "load_id", "ingestion_ts",
)


def to_minute(epoch_ms: Column | str) -> Column:
    """Epoch milliseconds to the UTC minute."""
    value = F.col(epoch_ms) if isinstance(epoch_ms, str) else epoch_ms
    return F.date_trunc("minute", F.timestamp_millis(value.cast("long")))


def ohlc_rules() -> dict[str, Column]:
    """Named price-record violations; each is TRUE for a broken bar."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "non_positive_price": (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0),
        "high_below_low": h < low,
        "open_out_of_range": (o > h) | (o < low),
        "close_out_of_range": (c > h) | (c < low),
    }


def reject_reason(now: Column | datetime | None = None, cfg: QualityConfig | None = None) -> Column:
    """First broken rule of a bar, NULL for a good one."""
    cfg = cfg or QualityConfig()
    missing = F.lit(False)
    for name in OHLCV:
        missing = missing | F.col(name).isNull()
    reason = F.when(missing, "null_ohlcv")
    for name, broken in ohlc_rules().items():
        reason = reason.when(broken, name)
    reason = reason.when(F.col("volume") < cfg.min_volume, "volume_below_minimum")
    if now is not None:
        limit = now if isinstance(now, Column) else F.lit(now)
        reason = reason.when(F.col("ts") > limit, "future_timestamp")
    return reason


def deduplicate(
    bars: DataFrame, cfg: QualityConfig | None = None, tiebreak: Sequence[str] = ("load_id",)
) -> DataFrame:
    """One bar per (symbol, ts): best source first, then the tie-break columns.

    A minimum over (rank, tie-breaks, rest of the row) combines on the map side,
    so a hot group of copies shrinks to one row per task before the shuffle.
    """
    cfg = cfg or QualityConfig()
    rank = F.array_position(F.lit(list(cfg.source_priority)), F.col("source"))
    # Unlisted sources come last.
    priority = F.when(rank > 0, rank).otherwise(len(cfg.source_priority) + 1)
    rest = [c for c in bars.columns if c not in ("symbol", "ts", *tiebreak)]
    best = F.min(F.struct(priority.alias("_priority"), *tiebreak, *rest))
    picked = bars.groupBy("symbol", "ts").agg(best.alias("_best"))
    return picked.select(
        *(c if c in ("symbol", "ts") else F.col(f"_best.{c}").alias(c) for c in bars.columns)
    )


def canonical(bars: DataFrame, ingested_at: datetime | Column) -> DataFrame:
    """Canonical column order with the constant columns."""
    stamp = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)
    return bars.withColumns(
        {"spread_est": F.lit(None).cast("double"), "ingestion_ts": stamp.cast("timestamp")}
    ).select(*CANONICAL)


def normalize(
    raw: DataFrame, now: datetime, cfg: QualityConfig | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw bars to (canonical bars, quarantined bars with their reason).

    Expects ``symbol, source, load_id``, OHLCV and ``open_time`` and/or
    ``ts_raw`` in epoch milliseconds.
    """
    stamps = [F.col(c) for c in ("open_time", "ts_raw") if c in raw.columns]
    judged = raw.withColumn("ts", to_minute(F.coalesce(*stamps))).withColumn(
        "reject_reason", F.when(F.col("ts").isNull(), "bad_timestamp").otherwise(reject_reason(now, cfg))
    )
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return canonical(deduplicate(good, cfg), now), judged.where(F.col("reject_reason").isNotNull())


def select_bars(
    bars: DataFrame,
    symbols: Sequence[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Symbol and inclusive time-range filter, pushed to the scan by Catalyst."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return bars


def holdout_split(
    bars: DataFrame, start: datetime | str, end: datetime | str
) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out) by the inclusive hold-out range."""
    held = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return bars.where(~held), bars.where(held)


def order_book_top(books: DataFrame) -> DataFrame:
    """Best bid, best ask and spread; NULL when a side is empty."""
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    return books.withColumns({"best_bid": bid, "best_ask": ask, "spread": ask - bid})
