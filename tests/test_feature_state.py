"""States merge to what the whole frame gives; tables updated by date equal a full run."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, assert_close, collect, walk
from tickloom.config import FeatureConfig
from tickloom.operators import feature_qc as fq
from tickloom.operators import feature_state as fs
from tickloom.operators.features import compute_features, winsorize
from tickloom.sources.feature_table import FeatureTable

COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def cells() -> pd.DataFrame:
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.exp(rng.normal(size=n) * 6), "c": rng.integers(-3, 4, n).astype(float), "d": np.full(n, 7.25), "e": np.full(n, np.nan)})
    pdf["a"] += 1e6
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.01, "b"] = np.inf
    pdf.loc[rng.random(n) < 0.3, "c"] = -0.0
    pdf["date"] = [dt.date(2024, 1, 1 + int(k)) for k in rng.integers(0, 4, n)]
    pdf["symbol"] = rng.choice(["x", "y"], n, p=[0.9, 0.1])
    return pdf


def test_bins_are_in_the_order_of_the_values():
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.normal(size=500), -np.exp(rng.normal(size=500) * 50), np.exp(rng.normal(size=500) * 50), [0.0, -0.0, 5e-324, -5e-324]]))
    assert (np.diff(fs.bin_of(values)) >= 0).all()
    assert len(np.unique(fs.bin_of(np.linspace(1, 2, 1000, endpoint=False)))) == 1 << fs.MANTISSA_BITS


@pytest.mark.parametrize("bracket", [1_000_000, 3])
def test_merged_states_give_the_statistics(spark, cells, bracket, monkeypatch):
    monkeypatch.setattr(fs, "CHUNK_ROWS", 400)
    monkeypatch.setattr(fs, "SPLITS", 8)
    frame = spark.createDataFrame(cells).repartition(5)
    states = fs.merged(fs.dated_states(frame, COLUMNS, pairs=True))
    stats = {r["feature"]: r for r in fs.column_summary(states, COLUMNS).collect()}
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    ranks = {r["feature"]: r for r in fs.order_statistics(states, frame, COLUMNS, probs, max_bracket=bracket).collect()}
    for c in COLUMNS:
        v = cells[c].to_numpy()
        good = v[np.isfinite(v)]
        r = stats[c]
        assert (r["rows"], r["count"], r["inf_count"], r["nan_count"]) == (len(v), len(good), np.isinf(v).sum(), np.isnan(v).sum())
        if not len(good):
            assert c not in ranks and r["mean"] is None and r["min"] is None
            continue
        assert r["mean"] == pytest.approx(good.mean(), rel=1e-12) and r["std"] == pytest.approx(good.std(ddof=1), rel=1e-9, abs=1e-12)
        want = np.quantile(good, probs)
        np.testing.assert_allclose(ranks[c]["quantiles"], want, rtol=1e-12)
        assert ranks[c]["below"] == [int((good < q).sum()) for q in ranks[c]["quantiles"]]
        assert ranks[c]["above"] == [int((good > q).sum()) for q in ranks[c]["quantiles"]]
    clean = cells[COLUMNS].replace([np.inf, -np.inf], np.nan)
    for r in fs.correlations(states, COLUMNS, 1e-9).collect():
        both = clean[[r["feature_a"], r["feature_b"]]].dropna()
        assert r["n"] == len(both)
        if "d" in (r["feature_a"], r["feature_b"]) or not len(both):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(np.corrcoef(both.T.to_numpy())[0, 1], abs=1e-9)


def test_states_by_key(spark, cells):
    frame = spark.createDataFrame(cells)
    states = fs.merged(fs.feature_states(frame, ["a", "c"], ["symbol"]), ["symbol"])
    got = {(r["symbol"], r["feature"]): r["quantiles"] for r in fs.order_statistics(states, frame, ["a", "c"], [0.2, 0.8], ["symbol"]).collect()}
    for (symbol, c), q in got.items():
        np.testing.assert_allclose(q, np.quantile(cells.loc[cells["symbol"] == symbol, c], [0.2, 0.8]), rtol=1e-12)
    assert len(got) == 4


def test_nothing_to_describe(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert fq.describe(empty, ["a", "b"]).count() == 0 and fq.extreme_counts(empty, ["a", "b"]).count() == 0
    assert fq.zscore_outliers(empty, ["a", "b"]).count() == 0


def test_table_updated_by_date_equals_a_full_run(spark, tmp_path):
    cfg = FeatureConfig(ma=(20,), ema=(), regression=(), momentum=(10,), rsi=())
    families = ("price_returns", "trend_momentum", "volatility_risk", "volume_liquidity", "regime")
    pdf = pd.concat([walk("AAA", 5000, 1), walk("BBB", 2500, 2)], ignore_index=True)
    bars = spark.createDataFrame(pdf, BAR_SCHEMA).withColumn("date", F.to_date("ts"))
    table = FeatureTable(f"{tmp_path}/table", cfg, families, winsorized=("ret_1m", "hl_range"))
    days = sorted(r["date"] for r in bars.select("date").distinct().collect())
    for part in ([days[0]], [days[1], days[2]], days[3:]):
        bars.where(F.col("date").isin(part)).write.mode("append").partitionBy("date").parquet(f"{tmp_path}/bars")
        table.update(spark, f"{tmp_path}/bars", None if part[0] == days[0] else part[0])
    names = ["symbol", "ts", "ret_1m", "hl_range", "ma_20", "volatility_20", "high_volatility_20", "high_volatility_50"]
    full = winsorize(compute_features(bars, cfg, families), ["ret_1m", "hl_range"], 0.01)
    got = table.read(spark).select(names)
    assert_close(collect(got, "symbol", "ts"), collect(full.select(names), "symbol", "ts"))
    with pytest.raises(ValueError, match="whole sample"):
        FeatureTable(f"{tmp_path}/other", FeatureConfig(volatility_mode="expanding")).update(spark, f"{tmp_path}/bars")


def test_a_worker_holds_few_rows_of_a_wide_frame():
    """The whole frame of 59 features: a chunk and the handful of copies made of it stay below 100 MB."""
    from tickloom.catalog.statistics import COLUMNS as every

    assert 10 * fs.CHUNK_ROWS * len(every) * 8 < 100 << 20


def test_statistics_of_all_features_read_a_stored_frame(spark, monkeypatch):
    """Statistics with several passes over the features compute them once."""
    from tickloom.catalog import statistics
    from tickloom.operators import feature_qc as fq

    sf, read, computed = "/root/testdata/sf0.001", [], []
    whole = statistics.all_features
    monkeypatch.setattr(statistics, "all_features", lambda *a: (computed.append(1), whole(*a))[1])
    for name in ("feature_set_gate", "quality_metrics", "analysis_summary"):
        monkeypatch.setattr(fq, name, lambda df, *a, **k: read.append(df) or df.limit(0))
    monkeypatch.setattr(statistics, "_pairs", lambda df: read.append(df))
    monkeypatch.setattr(fq, "with_quality", lambda meta, metrics: meta.selectExpr("*", "'' AS status", "0D AS non_na_pct"))
    for name in ("quality_gate_all", "metadata_quality_all", "analysis_summary_all"):
        getattr(statistics, name)(spark, sf)
    assert len(computed) == 3 and len(read) == 4
    for df in read:
        assert df.inputFiles() and all("/features" in f for f in df.inputFiles())
