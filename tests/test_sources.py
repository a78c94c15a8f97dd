"""Readers, writers, partition checks, incremental update, streaming replay."""

from __future__ import annotations

import json
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, assert_close, collect, walk
from tickloom.config import FeatureConfig, QualityConfig
from tickloom.operators.features import compute_features
from tickloom.operators.normalize import normalize
from tickloom.sources import readers, writers

MA_ONLY = FeatureConfig(ma=(20,), ema=(), regression=(), momentum=(), rsi=())


def ma20(bars):
    return compute_features(bars, MA_ONLY, ["trend_momentum"]).select("symbol", "ts", "ma_20")


def test_raw_csv_to_canonical_bars(spark, tmp_path):
    folder = tmp_path / "AAA" / "1m"
    folder.mkdir(parents=True)
    header = "open_time,open,high,low,close,volume,close_time,quote_volume,n_trades,taker_buy_base,taker_buy_quote,ignore\n"
    line = "{t},10,12,9,{c},5,0,0,1,0,0,0\n"
    t0 = 1704067200000
    (folder / "AAA-dump.csv").write_text(header + line.format(t=t0, c=11) + line.format(t=t0 + 60000, c=13) + "broken,line\n")
    rest = "ts,ts_raw,symbol,open,high,low,close,volume,source,load_id\n"
    (folder / "AAA_rest_1.csv").write_text(
        rest + f"x,{t0},AAA,10,12,9,10.5,5,binance:rest,r\n" + f"x,{t0 + 120000},AAA,10,12,9,10.5,5,binance:rest,r\n"
    )
    raw, malformed = readers.read_raw_bars(spark, str(tmp_path), ["AAA"])
    assert malformed.count() == 1
    clean, bad = normalize(raw, datetime(2025, 1, 1), QualityConfig())
    rows = collect(clean, "ts")
    # The dump wins the shared minute; close 13 lies above the high.
    assert rows["close"].tolist() == [11.0, 10.5]
    assert rows["source"].tolist() == ["binance:dump", "binance:rest"]
    assert rows["load_id"].tolist() == ["AAA-dump", "AAA_rest_1"]
    assert [r["reject_reason"] for r in bad.collect()] == ["close_out_of_range"]


def test_kline_files(spark, tmp_path):
    rows = [[1704067200000, "1.5", "2", "1", "oops", "3", 1704067259999, "0", 4, "0", "0", "0"]]
    (tmp_path / "ETHX_1m.json").write_text(json.dumps(rows))
    got = readers.read_klines_json(spark, str(tmp_path)).first()
    assert (got["symbol"], got["open"], got["close"], got["n_trades"]) == ("ETHX", 1.5, None, 4)
    assert got["ts"] == datetime(2024, 1, 1)


def test_trade_logs_with_two_headers(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("timestamp,symbol,action,quantity,price,execution_price,fees,trade_pnl,cash_after,run_id\n2024-01-01 00:00:00,A,buy,1,2,2.1,0.1,5,9,r1\n")
    b.write_text("timestamp,symbol,action,quantity,price,execution_price,fees,cash_after,run_id\n2024-01-01 00:00:00,B,sell,1,2,2.1,0.1,9,r2\n")
    rows = {r["symbol"]: r for r in readers.read_trades(spark, str(a), str(b)).collect()}
    assert rows["A"]["trade_pnl"] == 5.0 and rows["B"]["trade_pnl"] is None


@pytest.mark.parametrize("ext", ["parquet", "csv", "json"])
def test_save_and_load_by_extension(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    path = str(tmp_path / f"t.{ext}")
    writers.save_table(df, path)
    back = readers.load_table(spark, path, table_schema=df.schema)
    assert sorted(map(tuple, back.select("a", "b").collect())) == [(1, "x"), (2, "y")]


def test_run_metrics_and_audit(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"run_id": "r", "total_trades": 3, "final_positions": {"A": 1.5}}, indent=1))
    assert readers.read_run_metrics(spark, str(tmp_path / "m.json")).first()["final_positions"] == {"A": 1.5}
    (tmp_path / "audit.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "model": "m", "latency_ms": 5, "token_usage": {"in": 2}}\n')
    row = readers.read_audit(spark, str(tmp_path / "audit.jsonl")).first()
    assert row["latency_ms"] == 5.0 and row["token_usage"] == {"in": 2}


def test_partitioned_write_and_incremental_update(spark, tmp_path):
    # CCC has a bar in six hours only: its look-back spans days.
    sparse = walk("CCC", 4000, 3).iloc[::360]
    pdf = pd.concat([walk("AAA", 4000, 1), walk("BBB", 4000, 2), sparse], ignore_index=True)
    bars = spark.createDataFrame(pdf, BAR_SCHEMA)
    bars_path, feats_path = str(tmp_path / "bars"), str(tmp_path / "features")
    writers.write_partitioned(bars, bars_path)
    assert writers.validate_partitions(spark, bars_path) == {"symbols": 3, "dates": 9}
    early = spark.read.parquet(bars_path).where("date < DATE'2024-01-03'")
    writers.write_partitioned(ma20(early), feats_path)
    writers.update_features(spark, bars_path, feats_path, ma20, date(2024, 1, 3), lookback_bars=20)
    got = collect(spark.read.parquet(feats_path).select("symbol", "ts", "ma_20"), "symbol", "ts")
    got["symbol"] = got["symbol"].astype(str)
    assert_close(got, collect(ma20(bars), "symbol", "ts"))


def test_validate_partitions_rejects_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], BAR_SCHEMA).withColumn("date", F.to_date("ts"))
    path = str(tmp_path / "none")
    empty.write.parquet(path)
    with pytest.raises(ValueError):
        writers.validate_partitions(spark, path)
