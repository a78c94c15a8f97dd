"""State of the last bars: late, repeated and out-of-order bars give the batch features; quiet series start anew."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, assert_close, collect, walk
from tickloom.config import FeatureConfig
from tickloom.operators.features import compute_features, lookback_bars
from tickloom.streaming.lookback import STORE, stream_features, with_lookback

CFG = FeatureConfig(ma=(5, 20), ema=(), regression=(), momentum=(10,), rsi=(14,))
FAMILIES = ("price_returns", "trend_momentum")
COLUMNS = ("ret_1m", "ret_15m", "hl_range", "ma_5", "ma_20", "momentum_10", "breakout_20", "rsi_14")


def deliver(spark, folder, parts):
    """Write and process one delivery after the other; the features of all."""
    schema = spark.createDataFrame([], BAR_SCHEMA).schema
    spark.createDataFrame([], BAR_SCHEMA).write.parquet(f"{folder}/bars")
    for pdf in parts:
        spark.createDataFrame(pdf, BAR_SCHEMA).write.mode("append").parquet(f"{folder}/bars")
        source = spark.readStream.schema(schema).parquet(f"{folder}/bars")
        stream_features(spark, source, f"{folder}/out", f"{folder}/check", "30 minutes", CFG, FAMILIES, columns=COLUMNS).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def test_late_and_repeated_bars(spark, tmp_path):
    bars = pd.concat([walk("AAA", 400, 1), walk("BBB", 150, 2)], ignore_index=True)
    minute = (bars["ts"] - bars["ts"].min()).dt.total_seconds() // 60
    turn = (minute >= 120).astype(int) + (minute >= 300)
    late = (minute.between(95, 118) | minute.between(275, 299)) & (minute % 7 == 0)
    turn = (turn + late).clip(upper=2)
    parts = [bars[turn == k].sample(frac=1, random_state=k) for k in range(3)]
    # A wrong bar that is corrected before the watermark passes it.
    wrong = bars[(bars["symbol"] == "AAA") & (minute == 119)].assign(close=1.0, high=1.0)
    parts[0] = pd.concat([wrong, parts[0][~parts[0]["ts"].isin(wrong["ts"])]])
    parts[1] = pd.concat([parts[1], bars[(minute == 119)]]).drop_duplicates(["symbol", "ts"])
    end = bars.tail(1).assign(symbol="~", ts=bars["ts"].max() + pd.Timedelta("400 days"))
    got = collect(deliver(spark, str(tmp_path), [*parts, end]), "symbol", "ts")
    frame = spark.createDataFrame(bars, BAR_SCHEMA)
    want = collect(compute_features(frame, CFG, FAMILIES).select("symbol", "ts", *COLUMNS), "symbol", "ts")
    assert len(got) == 550
    assert_close(got, want)


def test_quiet_series_start_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    first, hour = walk("AAA", 10, 3), pd.Timedelta("1 hour")
    again = walk("AAA", 3, 4).assign(ts=lambda d: d["ts"] + 50 * hour)
    ends = [walk("~", 1, 5).assign(ts=lambda d, k=k: d["ts"] + k * hour) for k in (30, 60)]
    schema = spark.createDataFrame([], BAR_SCHEMA).schema
    borrowed = {}
    for idle in (None, 3_600_000):
        folder = f"{tmp_path}/{idle}"
        for part in (first, ends[0], again, ends[1]):
            spark.createDataFrame(part, BAR_SCHEMA).write.mode("append").parquet(f"{folder}/bars")
            source = spark.readStream.schema(schema).parquet(f"{folder}/bars")
            query = (
                with_lookback(source, 4, "1 minute", idle_ms=idle)
                .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
        out = spark.read.parquet(f"{folder}/out").where("symbol = 'AAA'")
        assert out.where(~F.col("borrowed")).count() == 13
        borrowed[idle] = out.where("borrowed").count()
    # The series that came back after two days found its last four bars only where nothing was dropped.
    assert borrowed[None] - borrowed[3_600_000] >= 4


def test_lookback_covers_the_families():
    assert lookback_bars(CFG, FAMILIES) >= 22
