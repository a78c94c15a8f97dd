"""Counts over long sliding windows against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.features import volatility_percentile
from tickloom.plans import order_index
from tickloom.plans.order_index import OrderIndex, sliding_count


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 257])
def test_index_counts_every_range(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 20, n).astype(float)
    low = rng.integers(0, n + 1, 500)
    high = np.minimum(n, low + rng.integers(0, n + 1, 500))
    bounds = rng.integers(-2, 23, 500) + rng.choice([0.0, 0.5], 500)
    got = OrderIndex(values).count_not_above(low, high, bounds)
    assert got.tolist() == [int((values[a:b] <= x).sum()) for a, b, x in zip(low, high, bounds)]


def series() -> pd.DataFrame:
    rng = np.random.default_rng(4)
    parts = []
    for key, n in (("a", 700), ("b", 90), ("c", 1)):
        value = rng.integers(0, 25, n).astype(float)
        value[rng.random(n) < 0.02] = np.nan
        parts.append(pd.DataFrame({"k": key, "t": rng.permutation(n) * 3, "v": value, "_pos": 1, "known_": key}))
    return pd.concat(parts, ignore_index=True)


def brute(pdf: pd.DataFrame, window: int) -> dict:
    out = {}
    for key, part in pdf.sort_values("t").groupby("k"):
        t, v = part["t"].to_numpy(), part["v"].to_numpy()
        for i in range(len(v)):
            inside = v[max(0, i - window + 1) : i + 1]
            full = i >= window - 1
            out[key, t[i]] = (int((inside <= v[i]).sum()), int((~np.isnan(inside)).sum())) if full else (None, None)
    return out


@pytest.mark.parametrize("window, block", [(1, 16), (5, 64), (64, 64), (100, 16), (333, 16), (650, 8), (90, 1000)])
def test_sliding_counts(spark, window, block):
    pdf = series()
    frame = spark.createDataFrame(pdf).drop("known_")
    got = sliding_count(frame, ["k"], "t", "v", window, rows_per_block=block, merges=3, rows_per_slice=100)
    assert got.columns == ["k", "t", "v", "_pos", "not_above", "known"]
    assert {(r["k"], r["t"]): (r["not_above"], r["known"]) for r in got.collect()} == brute(pdf, window)


def test_empty_series(spark):
    assert sliding_count(spark.createDataFrame([], "k string, t long, v double"), ["k"], "t", "v", 5).count() == 0


def test_percentile_over_a_window_longer_than_a_slice(spark, walk_bars):
    plain = volatility_percentile(walk_bars, 400).toPandas().set_index(["symbol", "ts"]).sort_index()
    cut = volatility_percentile(walk_bars, 400, rows_per_slice=60, rows_per_block=32).toPandas().set_index(["symbol", "ts"]).sort_index()
    want = plain.groupby("symbol")["vol"].transform(lambda v: v.rolling(400).rank(method="max", pct=True))
    np.testing.assert_allclose(plain["vol_percentile"], want)
    np.testing.assert_allclose(cut["vol_percentile"], want)
    assert want.notna().sum() > 700


@pytest.mark.parametrize("window, strict", [(300, False), (300, True), (None, True), (None, False)])
def test_no_group_outgrows_its_block(spark, monkeypatch, window, strict):
    """Long windows, half of the values equal, a series without a key: every group stays near a block of rows."""
    rng = np.random.default_rng(8)
    n, block = 900, 32
    values = np.where(rng.random(n) < 0.5, 0.0, rng.normal(0, 1, n))

    def bounded(held):
        assert len(held) <= 3 * block
        return OrderIndex(held)

    monkeypatch.setattr(order_index, "OrderIndex", bounded)
    rows = [(None if i % 3 == 0 else "a", i, float(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, t long, v double")
    got = {r["t"]: (r["not_above"], r["known"]) for r in sliding_count(frame, ["k"], "t", "v", window, strict=strict, rows_per_block=block).collect()}
    want = {}
    for own in ([r for r in rows if r[0] is None], [r for r in rows if r[0]]):
        v = np.array([r[2] for r in own])
        for i, (_, t, x) in enumerate(own):
            inside = v[max(0, i - (window or n) + 1) : i + 1]
            full = window is None or i >= window - 1
            want[t] = (int((inside < x).sum() if strict else (inside <= x).sum()), len(inside)) if full else (None, None)
    assert got == want
