"""Technical features of bar series."""

from tickloom.operators.features.engine import (
    compute_features,
    feature_names,
    lookback_bars,
    volatility_percentile,
    winsorize,
    with_metadata,
)

__all__ = [
    "compute_features",
    "feature_names",
    "lookback_bars",
    "volatility_percentile",
    "winsorize",
    "with_metadata",
]
