"""Quality rules, signals and performance on small hand-made inputs."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, collect
from tickloom.config import QualityConfig, TradeConfig
from tickloom.functions import timefn as tf
from tickloom.functions.text import hash_embedding, response_json, token_estimate
from tickloom.operators import feature_qc as fq
from tickloom.operators import performance as pf
from tickloom.operators import quality as qc
from tickloom.operators import signals as sg
from tickloom.operators import trades as td


def ladder(spark, rows=None):
    base = rows or [("A", datetime(2025, 1, 1, 0, i), 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 1000.0) for i in range(5)]
    return spark.createDataFrame(base, BAR_SCHEMA)


def failed(results):
    return {r["check"]: r["failed"] for r in results.collect() if r["failed"]}


def test_clean_bars_pass_every_check(spark):
    bars = ladder(spark)
    assert failed(qc.validate_ohlcv(bars)) == {}
    assert failed(qc.validate_timestamps(bars, datetime(2026, 1, 1))) == {}
    assert failed(qc.validate_frame(bars, bars.columns)) == {}
    qc.require_valid(qc.validate_ohlcv(bars))


def test_broken_bars_are_found(spark):
    t = datetime(2025, 1, 1)
    bars = ladder(spark, [("A", t, 100.0, 90.0, 99.0, 95.0, -100.0), ("A", t, 100.0, 102.0, 99.0, 101.0, 1.0)])
    bad = failed(qc.validate_ohlcv(bars))
    assert bad["high_below_low"] == 1 and bad["negative_volume"] == 1
    assert failed(qc.validate_timestamps(bars, datetime(2026, 1, 1))) == {"duplicate_timestamps": 1}
    assert failed(qc.validate_timestamps(bars, datetime(2024, 1, 1)))["future_timestamps"] == 2
    with pytest.raises(qc.ValidationError):
        qc.require_valid(qc.validate_ohlcv(bars))


def test_order_check_uses_arrival(spark):
    rows = [("A", datetime(2025, 1, 1, 0, m), i) for i, m in enumerate([0, 2, 1, 3])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int")
    assert failed(qc.validate_timestamps(df, datetime(2026, 1, 1), arrival="seq")) == {"monotonic_timestamps": 1}


def test_coverage_and_gaps(spark):
    bars = ladder(spark).where(F.minute("ts") != 2)
    row = qc.coverage(bars).first()
    assert (row["expected"], row["actual"], row["coverage_pct"], row["meets_threshold"]) == (5, 4, 80.0, False)
    gap = qc.gaps(bars, QualityConfig()).first()
    assert (gap["missing_bars"], gap["severity"]) == (1, "INFO")
    assert [r["ts"] for r in qc.missing_slots(bars).collect()] == [datetime(2025, 1, 1, 0, 2)]


def test_signal_rules_and_confidence(spark):
    rows = [(101.0, 100.0, 99.0, 50.0), (99.0, 100.0, 99.0, 50.0), (100.0, 100.0, 99.0, 20.0), (100.0, 100.0, 100.0, 80.0), (100.0, None, 99.0, 20.0), (100.0, 100.0, 99.0, 40.0)]
    df = spark.createDataFrame(rows, "close double, ma_20 double, ma_50 double, rsi_14 double")
    got = [(r["signal"], r["strategy"]) for r in sg.label_signals(df).collect()]
    assert got == [("buy", "momentum"), ("sell", "momentum"), ("buy", "rsi_extreme"), ("sell", "rsi_extreme"), ("hold", None), ("buy", "rsi_shift")]
    conf = spark.createDataFrame([(0.9, None), (None, None)], "a double, b double")
    scores = [r[0] for r in conf.select(sg.confidence({"a": 2.0, "b": 1.0})).collect()]
    assert scores == pytest.approx([0.7, 0.5])
    mapped = spark.createDataFrame([({"a": 0.9},)], "m map<string,double>")
    assert mapped.select(sg.confidence({"a": 2.0, "b": 1.0}, values="m")).first()[0] == pytest.approx(0.7)


def test_barrier_priority_and_ledger(spark):
    closes = [100.0, 98.0, 94.0, 120.0]
    rows = [("A", datetime(2025, 1, 1, 0, i), c, "buy" if i == 0 else "hold") for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, signal string")
    trip = td.barrier_outcomes(df, TradeConfig()).first()
    assert (trip["exit_reason"], trip["exit_price"]) == ("stop_loss", 94.0)
    assert td.first_round_trip(df).first()["exit_time"] == trip["exit_time"]
    legs = {r["action"]: r for r in td.trade_ledger(td.barrier_outcomes(df)).collect()}
    assert legs["buy"]["quantity"] == pytest.approx(50.0) and legs["buy"]["pnl"] == 0.0
    assert legs["sell"]["pnl"] == pytest.approx(-6 * 50 - 94 * 50 * 0.0015)


def test_positions_floor_at_zero(spark):
    rows = [("A", i, a, q) for i, (a, q) in enumerate([("buy", 2.0), ("sell", 5.0), ("buy", 3.0)])]
    legs = spark.createDataFrame(rows, "symbol string, ts int, action string, quantity double")
    assert td.open_positions(legs).count() == 0
    assert td.open_positions_ordered(legs).first()["quantity"] == 3.0


def test_performance_against_hand_values(spark):
    values = [100.0, 110.0, 99.0, 120.0]
    df = spark.createDataFrame([("r", datetime(2025, 1, 1 + i), v) for i, v in enumerate(values)], "run string, timestamp timestamp, portfolio_value double")
    row = pf.performance_summary(df, ["run"]).first()
    assert row["total_return"] == pytest.approx(0.2) and row["max_drawdown"] == pytest.approx(-0.1)
    assert row["annualized_return"] == pytest.approx(1.2 ** (365 / 3) - 1) and row["drawdown_periods"] == 1
    assert row["sortino_ratio"] == 0.0
    states = spark.createDataFrame([(50.0, 0.0, 10.0)], "total_exposure double, total_equity double, margin_used double")
    assert pf.portfolio_ratios(states).first()["leverage"] is None


def test_correlation_skips_incomplete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = fq.correlation_pairs(df, ["a", "b"]).first()
    assert got["n"] == 3 and got["correlation"] == pytest.approx(1.0)


def test_time_and_text_functions(spark):
    df = spark.createDataFrame([("2024-03-05T10:20:30.5Z", "one two  three"), ("05/03/2024", ""), ("2024-03-05T102030-0100", "x")], "t string, s string")
    stamps = [r[0] for r in df.select(tf.parse_timestamp("t")).collect()]
    assert stamps == [datetime(2024, 3, 5, 10, 20, 30, 500000), datetime(2024, 3, 5), datetime(2024, 3, 5, 11, 20, 30)]
    assert [r[0] for r in df.select(token_estimate("s")).collect()] == [3, 0, 1]
    assert len(df.select(hash_embedding("s").alias("e")).first()["e"]) == 128
    summer = spark.createDataFrame([(datetime(2024, 7, 1, 13, 30),), (datetime(2024, 7, 1, 20, 0, 1),)], "t timestamp")
    assert [r[0] for r in summer.select(tf.market_open("t", "stocks")).collect()] == [True, False]
    assert summer.select(tf.next_market_open("t", "stocks")).first()[0] == datetime(2024, 7, 2, 13, 30)
    text = spark.createDataFrame([('x ```json {"a": 1} ``` y',), ("{bad",)], "r string")
    assert [r[0] for r in text.select(response_json("r")).collect()] == ['{"a": 1}', None]


def test_winner_of_enum_counts_keeps_zeros(spark):
    df = spark.createDataFrame([("BUY",)], "signal_type string")
    got = {r["member"]: r["n"] for r in sg.enum_counts(df, "signal_type", sg.SIGNAL_TYPES).collect()}
    assert got["BUY"] == 1 and sum(got.values()) == 1 and len(got) == 9 and not math.isnan(got["SELL"])


def test_null_symbols_stay_in_reports(spark):
    from tickloom.operators import quality as qc

    rows = [("A", "2024-01-01", 1.0, "s", "l", 1), (None, "2024-01-01", 1.0, None, "l", 2), (None, "2024-01-01", 1.0, None, "m", 3), (None, "2024-01-02", 1.0, None, None, 4)]
    bars = spark.createDataFrame(rows, "symbol string, day string, close double, source string, load_id string, n int").select(
        "symbol", F.to_timestamp("day").alias("ts"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume")), "source", "load_id", "n"
    )
    got = {r["symbol"]: r for r in qc.quality_report(bars.drop("source")).collect()}
    assert {s: (r["rows"], r["duplicate_ts"], r["load_ids"]) for s, r in got.items()} == {"A": (1, 0, 1), None: (3, 1, 3)}
    table = qc.partition_validity(bars, "symbol", now=F.lit("2024-01-01").cast("timestamp"), arrival="n", unique=True)
    assert {r["symbol"]: (r["future"], r["duplicates"], r["disorder"], r["status"]) for r in table.collect()} == {"A": (0, 0, 0, "valid"), None: (1, 1, 0, "invalid")}


def test_equal_rows_are_counted_exactly(spark):
    from tickloom.operators import quality as qc

    rows = [(1, 0.0, "a"), (1, -0.0, "a"), (1, None, "a"), (1, None, "a"), (1, None, "a"), (2, 0.0, None), (3, float("nan"), "b"), (3, float("nan"), "b")]
    frame = spark.createDataFrame(rows, "k int, `x.y` double, s string")
    assert qc.duplicate_count(frame).first()["duplicates"] == 4
    assert qc.duplicate_count(frame.limit(0)).first()["duplicates"] == 0
