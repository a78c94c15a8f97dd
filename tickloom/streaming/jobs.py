"""Streaming transformations: DataFrame in, DataFrame out, stream or batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import QualityConfig
from tickloom.functions.numeric import count_if
from tickloom.operators.normalize import reject_reason
from tickloom.operators.operations import error_health_by_window
from tickloom.plans.scan import running
from tickloom.plans.slices import slice_series
from tickloom.session import durable
from tickloom.sources.writers import with_history


def bars_from_ticks(ticks: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """OHLCV bars per symbol; ticks later than the watermark are dropped.

    ``ticks``: symbol, ts (timestamp), price, volume. State is one partial
    aggregate per open (symbol, window), combined on the map side first.
    """
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "symbol")
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count("*").alias("ticks"),
        )
    )
    return bars.select(F.col("w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume", "ticks")


def checked_bars(
    bars: DataFrame, late: str = "1 hour", cfg: QualityConfig | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid bars without repeats, quarantined bars with their reason)."""
    judged = bars.withColumn("reject_reason", reject_reason(cfg=cfg))
    valid = (
        judged.where(F.col("reject_reason").isNull())
        .drop("reject_reason")
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["symbol", "ts"])
    )
    return valid, judged.where(F.col("reject_reason").isNotNull())


def error_health(errors: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Health score per window of an error stream (timestamp, severity)."""
    return error_health_by_window(errors.withWatermark("timestamp", late), width, slide)


def error_types(errors: DataFrame, width: str = "1 hour", slide: str = "20 minutes", late: str = "10 minutes", top: int = 3) -> DataFrame:
    """Errors by type per sliding window of a stream (timestamp, error_type): total, types, the commonest ones.

    Counts per (window, type) first, which spread and combine on the map side; when a window is over its counts meet in
    one row. State holds one number for each type of an open window, and ties go to the smaller type.
    """
    counts = (
        errors.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width, slide).alias("w"), "error_type")
        .agg(F.count("*").alias("n"))
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "error_type")))
    whole = counts.groupBy("w").agg(F.sum("n").alias("errors"), F.count("*").alias("types"), ranked.alias("ranked"))
    return whole.select(
        F.col("w.start").alias("window_start"), "errors", "types",
        F.col("ranked")[0]["error_type"].alias("most_common"), (-F.col("ranked")[0]["rank"]).alias("most_common_count"),
        F.transform(F.slice("ranked", 1, top), lambda r: F.struct(r["error_type"].alias("error_type"), (-r["rank"]).alias("n"))).alias("top"),
    )


def analysis_metrics_by_window(analyses: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Latency, confidence and action mix per window."""
    source = analyses.withWatermark("timestamp", late) if late else analyses
    kinds = ("hold", "enter_long", "enter_short", "exit", "reduce_position", "increase_position")
    return (
        source.groupBy(F.window("timestamp", width).alias("w"))
        .agg(
            F.count("*").alias("analyses"),
            F.avg("latency_ms").alias("latency_avg"),
            F.min("latency_ms").alias("latency_min"),
            F.max("latency_ms").alias("latency_max"),
            F.avg("action.confidence").alias("confidence_avg"),
            *(count_if(F.col("action.type") == k).alias(f"n_{k}") for k in kinds),
            count_if(F.col("action.type").isNull()).alias("n_unknown"),
        )
        .select(F.col("w.start").alias("window_start"), "*")
        .drop("w")
    )


def trading_sessions(ticks: DataFrame, gap: str = "60 minutes", late: str | None = None) -> DataFrame:
    """Activity sessions per symbol, closed after ``gap`` without a tick."""
    source = ticks.withWatermark("ts", late) if late else ticks
    return (
        source.groupBy(F.session_window("ts", gap).alias("w"), "symbol")
        .agg(F.count("*").alias("ticks"))
        .select("symbol", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "ticks")
    )


def stored_sessions(ticks: DataFrame, minutes: int = 60, *, rows_per_slice: int | None = None) -> DataFrame:
    """The sessions of stored ticks, for symbols of any length.

    Ticks of one instant combine on the map side; a session begins where the one before is ``minutes``
    or more away. Both steps walk sliced series, so a busy symbol spreads over tasks.
    """
    instants = durable(ticks.where(F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(F.count("*").alias("ticks")))
    series = slice_series(instants, ["symbol"], ["ts"], lookback=1, rows_per_slice=rows_per_slice)
    gap = F.unix_micros(F.col("ts")) - F.unix_micros(F.lag("ts").over(series.window))
    begun = series.owned(series.df.withColumn("_new", (F.coalesce(gap >= minutes * 60_000_000, F.lit(True))).cast("int")))
    numbered = running(durable(begun), ["symbol"], ["ts"], {"_session": ("sum", F.col("_new"))}, rows_per_slice=rows_per_slice)
    return (
        numbered.groupBy("symbol", "_session")
        .agg(
            F.min("ts").alias("session_start"),
            (F.max("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("session_end"),
            F.sum("ticks").alias("ticks"),
        )
        .drop("_session")
    )


def features_per_batch(
    spark: SparkSession,
    bars_path: str,
    features_path: str,
    compute: Callable[[DataFrame], DataFrame],
    lookback_bars: int,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: store the new bars, refresh the features of their dates.

    Uses the batch feature code (sliced, so a hot symbol spreads over tasks) on
    the dates from the first touched one on plus the stored history that holds
    ``lookback_bars`` bars of each symbol, and replaces only those date partitions, so a
    replayed batch gives the same result and a late bar refreshes everything after it.
    ``lookback_bars`` is the longest look-back of ``compute``.
    """
    def handle(batch: DataFrame, _: int) -> None:
        dated = batch.withColumn("date", F.to_date("ts"))
        days = dated.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
        first = days["first"]
        if first is None:
            return
        (
            _merged(spark, dated, bars_path, first, days["last"])
            .repartitionByRange("symbol", "date", "ts")
            .sortWithinPartitions("symbol", "date", "ts")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("symbol", "date")
            .parquet(bars_path)
        )
        history = with_history(spark.read.parquet(bars_path), first, lookback_bars)
        fresh = compute(history).where(F.col("date") >= F.lit(first))
        (
            fresh.repartitionByRange("symbol", "date", "ts")
            .sortWithinPartitions("symbol", "date", "ts")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("symbol", "date")
            .parquet(features_path)
        )

    return handle


def _merged(
    spark: SparkSession, batch: DataFrame, bars_path: str, first: date, last: date
) -> DataFrame:
    """The batch plus the stored bars of the same (symbol, date), batch rows winning."""
    try:
        stored = spark.read.parquet(bars_path)
    except Exception as error:  # noqa: BLE001 - only a missing table is expected
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return batch
    # A literal date range prunes the partitions of the stored table.
    stored = stored.where(F.col("date").between(F.lit(first), F.lit(last)))
    touched = batch.select("symbol", "date").distinct()
    kept = stored.join(touched, ["symbol", "date"], "left_semi").join(
        batch.select("symbol", "ts"), ["symbol", "ts"], "left_anti"
    )
    # The result overwrites the partitions it was read from, so it is made durable first.
    return durable(kept.select(*batch.columns).unionByName(batch))
