from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def walk(symbol: str, n: int, seed: int, start: str = "2024-01-01") -> pd.DataFrame:
    """Seeded random-walk minute bars that satisfy the OHLC rules."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    opened = np.concatenate([[100.0], close[:-1]])
    spread = np.abs(rng.normal(0, 0.0005, (2, n)))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq="min"),
            "open": opened,
            "high": np.maximum(opened, close) * (1 + spread[0]),
            "low": np.minimum(opened, close) * (1 - spread[1]),
            "close": close,
            "volume": np.exp(rng.normal(8, 0.5, n)),
        }
    )


BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def walk_pdf() -> pd.DataFrame:
    # One symbol holds two thirds of the rows.
    return pd.concat([walk("AAA", 1200, 1), walk("BBB", 450, 2), walk("CCC", 150, 3)], ignore_index=True)


@pytest.fixture(scope="session")
def walk_bars(spark, walk_pdf):
    shuffled = walk_pdf.sample(frac=1, random_state=7)
    return spark.createDataFrame(shuffled, BAR_SCHEMA).cache()


def collect(df, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def assert_close(left: pd.DataFrame, right: pd.DataFrame, tol: float = 1e-9) -> None:
    assert sorted(left.columns) == sorted(right.columns)
    assert len(left) == len(right)
    for c in left.columns:
        a, b = left[c], right[c]
        if a.dtype.kind in "fi" and b.dtype.kind in "fi":
            x, y = a.to_numpy(float), b.to_numpy(float)
            assert (np.isnan(x) == np.isnan(y)).all(), f"{c}: null positions differ"
            np.testing.assert_allclose(x, y, rtol=tol, atol=tol, err_msg=c)
        else:
            assert a.tolist() == b.tolist(), c
