"""Streams give the batch result, also when data arrives in several files and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, assert_close, collect, walk
from tickloom.config import FeatureConfig
from tickloom.operators.features import compute_features
from tickloom.streaming import jobs

MA_ONLY = FeatureConfig(ma=(20,), ema=(), regression=(), momentum=(), rsi=())


def test_bars_from_tick_files_match_batch(spark, tmp_path):
    ticks = spark.range(0, 3000).select(
        F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7).alias("ts"),
        (100 + F.sin("id")).alias("price"),
        F.lit(1.0).alias("volume"),
    )
    source = str(tmp_path / "ticks")
    for k in range(3):
        ticks.where((F.col("ts") >= F.timestamp_seconds(F.lit(1704067200 + k * 7000))) & (F.col("ts") < F.timestamp_seconds(F.lit(1704067200 + (k + 1) * 7000)))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        jobs.bars_from_ticks(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = collect(spark.table("bars_out"), "symbol", "ts")
    want = collect(jobs.bars_from_ticks(ticks, "1 minute"), "symbol", "ts")
    # Minutes still open at the end of the stream stay in state.
    want = want[want["ts"] <= got["ts"].max()].reset_index(drop=True)
    assert len(got) > 900
    assert_close(got, want)


def test_features_follow_bars_over_batches(spark, tmp_path):
    pdf = pd.concat([walk("AAA", 3000, 1), walk("BBB", 3000, 2)], ignore_index=True)
    bars = spark.createDataFrame(pdf, BAR_SCHEMA)

    def compute(df):
        return compute_features(df, MA_ONLY, ["trend_momentum"]).select("symbol", "ts", "date", "ma_20")

    handle = jobs.features_per_batch(spark, str(tmp_path / "bars"), str(tmp_path / "features"), compute, lookback_bars=20)
    cuts = ["2024-01-01", "2024-01-01 18:00", "2024-01-02 09:30", "2024-01-09"]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = bars.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
        handle(batch, i)
        if i == 1:
            # A replayed batch changes nothing.
            handle(batch, i)
    got = collect(spark.read.parquet(str(tmp_path / "features")).select("symbol", "ts", "ma_20"), "symbol", "ts")
    got["symbol"] = got["symbol"].astype(str)
    want = collect(compute(bars.withColumn("date", F.to_date("ts"))).drop("date"), "symbol", "ts")
    assert_close(got, want)
