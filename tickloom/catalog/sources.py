"""Readers and writers: tables go out in each format and come back, compared with what went in."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import HOURLY_BARS, TICK_LEGS, rnd
from tickloom.config import FeatureConfig, config_hash
from tickloom.functions.numeric import rounded
from tickloom.operators.features import compute_features
from tickloom.operators.features.engine import with_metadata
from tickloom.session import durable, work_folder
from tickloom.sources import readers, writers
from tickloom.sources.tables import hourly_bars, table, tick_legs


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("bars_partitioned_roundtrip", f"WITH {HOURLY_BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def bars_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars through the partitioned sink and back."""
    path = work_folder(spark, "bars")
    writers.write_partitioned(hourly_bars(spark, sf_dir), path)
    return readers.read_bars(spark, path).select("symbol", ntz("ts"), "open", "high", "low", "close", "volume")


@query("partition_dates", f"WITH {HOURLY_BARS} SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS dates FROM bars GROUP BY 1")
def partition_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "bars")
    writers.write_partitioned(hourly_bars(spark, sf_dir), path)
    writers.validate_partitions(spark, path)
    return writers.partition_counts(spark, path)


@query(
    "raw_csv_roundtrip",
    f"WITH {HOURLY_BARS} SELECT symbol, epoch_ms(ts) AS open_time, open, high, low, close, volume, 'binance:dump' AS source FROM bars",
)
def raw_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files per symbol, in the dump layout, through the raw reader."""
    path, bars = work_folder(spark, "raw"), hourly_bars(spark, sf_dir).cache()
    zero = F.lit(0)
    for (symbol,) in bars.select("symbol").distinct().collect():  # one folder per symbol is the layout
        bars.where(F.col("symbol") == symbol).select(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), "open", "high", "low", "close", "volume",
            *(zero.alias(c) for c in ("close_time", "quote_volume", "n_trades", "taker_buy_base", "taker_buy_quote", "ignore")),
        ).write.option("header", True).csv(f"{path}/{symbol}/1m")
    good, _ = readers.read_raw_bars(spark, path)
    return good.select("symbol", "open_time", "open", "high", "low", "close", "volume", "source")


def _pack(folder: str):
    """One archive per symbol and day, written by the task that holds its lines."""

    def write(table: pa.Table) -> pa.Table:
        symbol, day = table["symbol"][0].as_py(), table["day"][0].as_py()
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(f"{root}/{symbol}/1m")
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{symbol}-1m-{day}.csv", "open_time,rest\n" + "\n".join(table.sort_by("value")["value"].to_pylist()) + "\n")
        with system.open_output_stream(f"{root}/{symbol}/1m/{symbol}-1m-{day}.zip") as out:
            out.write(body.getvalue())
        return table.select(["symbol", "day"]).slice(0, 1)

    return write


@query(
    "zipped_dumps",
    f"""WITH {HOURLY_BARS} SELECT symbol, epoch_ms(ts) AS open_time, open, high, low, close, volume, 'binance:dump' AS source,
    concat(symbol, '-1m-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS load_id FROM bars
    WHERE symbol IN ('view', 'click') AND CAST(ts AS DATE) >= DATE '2024-01-10'""",
)
def zipped_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars packed into one archive per symbol and day, then some symbols and days of them read."""
    path = work_folder(spark, "zips")
    fields = [F.unix_millis(F.col("ts").cast("timestamp")), *(F.col(c) for c in ("open", "high", "low", "close", "volume")), *[F.lit(0)] * 6]
    lines = hourly_bars(spark, sf_dir).select("symbol", F.to_date("ts").cast("string").alias("day"), F.concat_ws(",", *fields).alias("value"))
    durable(lines.groupBy("symbol", "day").applyInArrow(_pack(path), "symbol string, day string"))
    good, _ = readers.read_zipped_bars(spark, path, ["view", "click"], first_day="2024-01-10")
    return good.select("symbol", "open_time", "open", "high", "low", "close", "volume", "source", "load_id")


@query(
    "audit_jsonl_roundtrip",
    """SELECT ts AS "timestamp", event_type, value * 10 AS latency_ms, CASE WHEN event_type = 'error' THEN 'failed' END AS error, concat('u', user_id) AS symbol FROM events""",
)
def audit_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events as JSON lines and back."""
    path = work_folder(spark, "audit") + ".jsonl"
    events = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "event_type", (F.col("value") * 10).alias("latency_ms"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.concat(F.lit("u"), F.col("user_id")).alias("symbol"),
    )
    writers.save_table(events, path)
    return readers.read_audit(spark, path).select(ntz("timestamp"), "event_type", "latency_ms", "error", "symbol")


@query(
    "trade_log_csv_roundtrip",
    f"""WITH {TICK_LEGS} SELECT ts AS "timestamp", symbol, action, quantity, price, CASE WHEN event_id % 2 = 0 THEN price - 1 END AS trade_pnl FROM tick_legs""",
)
def trade_log_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade logs with and without the P&L column, merged by name."""
    legs = tick_legs(spark, sf_dir).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    columns = ["timestamp", "symbol", "action", "quantity", "price"]
    old, new = work_folder(spark, "legs") + ".csv", work_folder(spark, "legs") + ".csv"
    writers.save_table(legs.where("event_id % 2 = 1").select(*columns), old)
    writers.save_table(legs.where("event_id % 2 = 0").select(*columns, (F.col("price") - 1).alias("trade_pnl")), new)
    return readers.read_trades(spark, old, new).select(ntz("timestamp"), "symbol", "action", "quantity", "price", "trade_pnl")


@query("report_csv_roundtrip", f"WITH {HOURLY_BARS} SELECT symbol, CAST(count(*) AS VARCHAR) AS bars, CAST(max(volume) AS VARCHAR) AS busiest FROM bars GROUP BY 1")
def report_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "report") + ".csv"
    report = hourly_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("volume").alias("busiest"))
    writers.write_report(report, path)
    return readers.load_table(spark, path)


_META = FeatureConfig(ma=(5,), ema=(), regression=(), momentum=(), rsi=())


@query(
    "features_metadata_roundtrip",
    f"""WITH {HOURLY_BARS} SELECT symbol, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {rnd('CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END')} AS ma_5,
    '{config_hash(_META)}' AS config_hash FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def features_metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another window configuration, with its metadata columns, stored and read as a feature table."""
    path = work_folder(spark, "features")
    features = with_metadata(compute_features(hourly_bars(spark, sf_dir), _META, ["trend_momentum"]), _META, datetime(2025, 1, 1))
    features.drop("date").write.parquet(path)
    read = readers.read_features(spark, path)
    return read.select("symbol", ntz("ts"), F.col("date").cast("string").alias("date"), rounded("ma_5").alias("ma_5"), "config_hash")
