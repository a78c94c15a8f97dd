"""Feature computation: one shuffle and one sort of the bars on (symbol, slice).

The merged declarations become a short stack of projections over one window
specification: lags, row-level series, rolling aggregates, outputs, and the few
rolling aggregates of outputs. Selecting a subset of the result lets Catalyst
prune the windows nobody reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import FeatureConfig, config_hash
from tickloom.functions.numeric import clip, flag
from tickloom.functions.rolling import add_long_windows, add_rolls, ewm_lookback, is_long
from tickloom.operators.features.families import FAMILIES, documented_extras
from tickloom.operators.features.family import Family
from tickloom.plans.order_index import sliding_count
from tickloom.plans.quantiles import quantiles
from tickloom.plans.ranks import above_so_far
from tickloom.plans.slices import BORROWED, SLICE, slice_series
from tickloom.plans.small import join_small

KEY, TIME = "symbol", "ts"


def _declaration(cfg: FeatureConfig, families: Sequence[str]) -> Family:
    merged = Family()
    for name in families:
        build = documented_extras if name == "extras" else FAMILIES[name]
        merged = merged.merge(build(cfg))
    return merged


def _lookback(spec: Family) -> int:
    rolls = [n for _, _, n in spec.rolls] or [1]
    late = [n for _, _, n in spec.late_rolls] or [0]
    ewm = [ewm_lookback(alpha) for _, alpha, _ in spec.ewm.values()] or [0]
    slopes = [n for _, n in spec.slopes.values()] or [0]
    lags = [k for _, k in spec.lags.values()] or [0]
    # Row-level series look one bar back; late rolls sit on top of the others.
    return max(max(rolls), max(ewm), max(slopes), max(lags)) + max(late) + 2


def lookback_bars(cfg: FeatureConfig | None = None, families: Sequence[str] = tuple(FAMILIES)) -> int:
    """How many bars before its own a feature of these families depends on (whole-history limits aside)."""
    return _lookback(_declaration(cfg or FeatureConfig(), families))


def compute_features(
    bars: DataFrame,
    cfg: FeatureConfig | None = None,
    families: Sequence[str] = tuple(FAMILIES),
    *,
    order: Sequence[str] = (TIME,),
    rows_per_slice: int | None = None,
    whole_history: bool = True,
) -> DataFrame:
    """Bars plus the feature columns of the chosen families.

    Without ``whole_history`` the flags that need a symbol's whole history (``high_volatility_n``) are left out.

    ``bars`` must carry ``symbol, ts, open, high, low, close, volume`` with
    unique ``(symbol, ts)`` and no nulls (what :mod:`normalize` produces). Add
    ``"extras"`` to ``families`` for the documented-only features.
    """
    cfg = cfg or FeatureConfig()
    spec = _declaration(cfg, families)
    series = slice_series(
        bars, [KEY], order, lookback=_lookback(spec), rows_per_slice=rows_per_slice
    )
    w = series.window
    kept = list(bars.columns)
    df = series.df
    lags = {name: F.lag(value, k).over(w) for name, (value, k) in spec.lags.items()}
    df = df.withColumns({"_row": F.row_number().over(w), **lags})
    df = df.withColumns(spec.derived) if spec.derived else df
    long = sorted(r for r in spec.rolls if is_long(r))
    df = add_long_windows(df, w, spec.ewm, spec.slopes, long)
    if any(kind == "autocov" for kind, _, _ in spec.late_rolls):
        df = df.withColumn("_ret_lag", F.lag("_ret", 1).over(w))
    df = add_rolls(df, w, sorted(spec.rolls - set(long)))
    df = df.withColumns(spec.outputs)
    if spec.late_rolls:
        df = add_rolls(df, w, sorted(spec.late_rolls)).withColumns(spec.late_outputs)
    features = [*spec.outputs, *spec.late_outputs]
    extra = [SLICE, BORROWED] if series.sliced else []
    df = series.owned(df.select(*kept, *features, *extra))
    if "regime" in families:
        if "volatility_risk" not in families:
            raise ValueError("the regime family needs the volatility_risk family")
        df = _flag_high_volatility(df, cfg, rows_per_slice) if whole_history else df
    return df


def _flag_high_volatility(
    df: DataFrame, cfg: FeatureConfig, rows_per_slice: int | None
) -> DataFrame:
    """``high_volatility_n``: rolling std above its own per-symbol quantile.

    ``full_sample`` takes the quantile over the whole history, so the flag looks
    ahead; it is one distributed aggregate, joined back on the symbol.
    ``expanding`` uses the bars so far, for all columns in one pass over the values, which are computed once and stored.
    """
    names = [f"volatility_{n}" for n in cfg.volatility]
    q = cfg.volatility_quantile
    if cfg.volatility_mode == "expanding":
        flags, repeated = above_so_far(df, KEY, TIME, names, q, rows_per_block=rows_per_slice)
        if not repeated:
            above = flags.select(KEY, TIME, *(F.col(name).alias(f"_above_{name}") for name in names))
            df = df.join(above, [KEY, TIME], "left")
            return df.withColumns({f"high_{name}": flag(F.col(f"_above_{name}")) for name in names}).drop(*(f"_above_{name}" for name in names))
        # Bars of one instant meet each other's flags, and go into the next column's counts as often.
        values = df.select(KEY, TIME, *names)
        for name in names:
            known = values.where(F.col(name).isNotNull()).select(KEY, TIME, name)
            above = above_so_far(known, KEY, TIME, [name], q, rows_per_block=rows_per_slice)[0].withColumnRenamed(name, "_above")
            df = df.join(above, [KEY, TIME], "left").withColumn(f"high_{name}", flag(F.col("_above"))).drop("_above")
            values = values.join(above.select(KEY, TIME), [KEY, TIME], "left")
        return df
    if cfg.volatility_mode != "full_sample":
        raise ValueError(f"unknown volatility_mode {cfg.volatility_mode!r}")
    limits = _limits(df, names, [q])
    flags = {f"high_{name}": flag(F.col(name) > F.get(f"_lim_{name}", F.lit(0))) for name in names}
    return join_small(df, limits, [KEY]).withColumns(flags).drop(*(f"_lim_{c}" for c in names))


def _limits(df: DataFrame, columns: Sequence[str], probs: Sequence[float], key: str = KEY) -> DataFrame:
    """Per-key quantiles of several columns: ``key, _lim_<column> array<double>``."""
    longform = df.select(key, *(F.col(c).cast("double") for c in columns)).unpivot(
        [key], list(columns), "feature", "value"
    )
    return (
        quantiles(longform, [key, "feature"], "value", probs)
        .groupBy(key)
        .pivot("feature", list(columns))
        .agg(F.first("quantiles"))
        .select(key, *(F.col(c).alias(f"_lim_{c}") for c in columns))
    )


def feature_names(cfg: FeatureConfig | None = None, families: Sequence[str] = tuple(FAMILIES)) -> list[str]:
    """Output columns of :func:`compute_features` beyond the bar columns."""
    cfg = cfg or FeatureConfig()
    spec = _declaration(cfg, families)
    flags = [f"high_volatility_{n}" for n in cfg.volatility] if "regime" in families else []
    return [*spec.outputs, *spec.late_outputs, *flags]


def winsorize(
    df: DataFrame, columns: Sequence[str], fraction: float = 0.01, key: str = KEY
) -> DataFrame:
    """Clip feature columns to their per-symbol [p, 1-p] quantiles."""
    limits = _limits(df, columns, [fraction, 1 - fraction], key)
    clipped = {
        c: clip(F.col(c), F.get(f"_lim_{c}", F.lit(0)), F.get(f"_lim_{c}", F.lit(1))) for c in columns
    }
    return join_small(df, limits, [key]).withColumns(clipped).drop(*(f"_lim_{c}" for c in columns))


def with_metadata(df: DataFrame, cfg: FeatureConfig, computed_at: datetime) -> DataFrame:
    """Lineage columns: when, which version, which configuration."""
    return df.withColumns(
        {
            "feature_computed_at": F.lit(computed_at),
            "feature_version": F.lit(cfg.version),
            "config_hash": F.lit(config_hash(cfg)),
        }
    )


def volatility_percentile(
    bars: DataFrame,
    window: int = 129_600,
    volatility_window: int = 20,
    *,
    rows_per_slice: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """``vol_percentile``: share of the last ``window`` volatilities <= the current one.

    An order statistic over a quarter of one-minute bars, from the index of :mod:`tickloom.plans.order_index`.
    NULL until the window is full, and where it holds a bar without a volatility.
    """
    cfg = replace(FeatureConfig(), volatility=(volatility_window,))
    vol = compute_features(bars, cfg, ["volatility_risk"], rows_per_slice=rows_per_slice).select(
        KEY, TIME, F.col(f"volatility_{volatility_window}").alias("vol")
    )
    counted = sliding_count(vol, [KEY], TIME, "vol", window, rows_per_block=rows_per_block, rows_per_slice=rows_per_slice)
    share = F.when(F.col("known") == window, F.col("not_above") / window)
    return counted.select(KEY, TIME, "vol", share.alias("vol_percentile"))
