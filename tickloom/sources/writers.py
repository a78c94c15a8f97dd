"""Writers: partitioned tables, reports, incremental updates, partition checks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.plans.small import join_small
from tickloom.session import durable
from tickloom.sources.readers import FORMATS


def save_table(df: DataFrame, path: str, fmt: str = "auto", mode: str = "overwrite") -> None:
    """Write by extension; Spark's commit protocol keeps a failed write invisible."""
    kind = FORMATS[path.rstrip("/").rsplit(".", 1)[-1].lower()] if fmt == "auto" else FORMATS.get(fmt, fmt)
    writer = df.write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_partitioned(
    df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000
) -> None:
    """``symbol=/date=`` Parquet, snappy, sorted by ``ts`` inside each file.

    Range partitioning on (symbol, date, ts) sizes the tasks by sampled volume:
    a hot symbol or date is spread over several tasks, while small dates share
    one task and still end up in one file each.
    """
    dated = df if "date" in df.columns else df.withColumn("date", F.to_date("ts"))
    (
        dated.repartitionByRange("symbol", "date", "ts")
        .sortWithinPartitions("symbol", "date", "ts")
        .write.mode(mode)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("symbol", "date")
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result (statistics, rankings, summaries) as one file.

    The exchange keeps the stages that make the result as parallel as they are.
    """
    save_table(df.repartition(1), path, fmt)


def partition_counts(spark: SparkSession, path: str) -> DataFrame:
    """Date partitions per symbol; reads partition columns only."""
    return (
        spark.read.parquet(path).select("symbol", "date").distinct().groupBy("symbol").agg(F.count("*").alias("dates"))
    )


def validate_partitions(spark: SparkSession, path: str) -> dict[str, int]:
    """Totals over :func:`partition_counts`; raises when there are none."""
    totals = partition_counts(spark, path).agg(
        F.count("*").alias("symbols"), F.coalesce(F.sum("dates"), F.lit(0)).alias("dates")
    ).first()
    if not totals["symbols"] or not totals["dates"]:
        raise ValueError(f"no symbol/date partitions under {path}")
    return {"symbols": totals["symbols"], "dates": totals["dates"]}


def with_history(bars: DataFrame, since: date, lookback_bars: int) -> DataFrame:
    """The bars from ``since`` on and, per symbol, whole dates before it holding at least ``lookback_bars`` bars.

    Counted per symbol, so a sparse symbol reaches back as far as it needs; a symbol with
    fewer bars gives all it has. One row per (symbol, date) is ranked, and the earliest date needed prunes the scan.
    """
    day = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    counts = bars.where(F.col("date") < F.lit(since)).groupBy("symbol", "date").agg(F.count("*").alias("n"))
    needed = counts.withColumn("later", F.coalesce(F.sum("n").over(day), F.lit(0))).where(F.col("later") < lookback_bars)
    starts = durable(needed.groupBy("symbol").agg(F.min("date").alias("_first")))
    earliest = starts.agg(F.min("_first")).first()[0] or since
    recent = bars.where(F.col("date") >= F.lit(earliest))
    return join_small(recent, starts, ["symbol"]).where(F.col("date") >= F.coalesce("_first", F.lit(since))).drop("_first")


def update_features(
    spark: SparkSession,
    bars_path: str,
    features_path: str,
    compute: Callable[[DataFrame], DataFrame],
    since: date,
    lookback_bars: int,
) -> None:
    """Recompute and replace the date partitions from ``since`` on.

    Reads the new dates plus, per symbol, the history that ``lookback_bars`` needs (the longest look-back
    of ``compute`` in bars), and overwrites only the new partitions. Features over a whole
    history (quantile flags, winsorising) have no such look-back and belong in a full run.
    """
    fresh = compute(with_history(spark.read.parquet(bars_path), since, lookback_bars))
    fresh = fresh if "date" in fresh.columns else fresh.withColumn("date", F.to_date("ts"))
    (
        fresh.where(F.col("date") >= F.lit(since))
        .repartitionByRange("symbol", "date", "ts")
        .sortWithinPartitions("symbol", "date", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("symbol", "date")
        .parquet(features_path)
    )
