"""Quality and statistics of feature columns (wide frames, one pass where possible)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import count_if
from tickloom.operators.feature_state import column_summary, correlations, feature_states, merged, order_statistics
from tickloom.plans.small import join_small
from tickloom.session import durable


# A deviation below this share of the mean is rounding of a constant, and counts as none.
ROUNDING = 1e-9


def finite(name: str) -> Column:
    """The column as a double; NaN and infinite values are missing."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < math.inf, value)


def long_form(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), raw: bool = False) -> DataFrame:
    """``ids, feature, value``: one row per feature cell; NaN and infinite values are missing unless ``raw``."""
    wide = df.select(*ids, *((F.col(c).cast("double") if raw else finite(c)).alias(c) for c in columns))
    return wide.unpivot(list(ids), list(columns), "feature", "value")


def measured(df: DataFrame, columns: Sequence[str], pairs: bool = False, bins: bool = True) -> DataFrame:
    """The merged states of a frame: one pass, a bounded number of rows for each column, whatever its length."""
    return durable(merged(feature_states(df, columns, pairs=pairs, bins=bins)))


def describe(df: DataFrame, columns: Sequence[str], states: DataFrame | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per feature; ``states`` that are at hand spare a pass."""
    states = states or measured(df, columns)
    ranks = order_statistics(states, df, columns, [0.25, 0.5, 0.75]).select(
        "feature", *(F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75")))
    )
    stats = column_summary(states, columns).join(ranks, "feature", "left")
    return stats.select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def feature_ranges(df: DataFrame, columns: Sequence[str], states: DataFrame | None = None) -> DataFrame:
    """min, max, mean, std and missing count per feature."""
    stats = column_summary(states or measured(df, columns, bins=False), columns)
    return stats.select("feature", "min", "max", "mean", "std", (F.col("nan_count") + F.col("inf_count")).alias("nan_count"))


def missing_counts(df: DataFrame, columns: Sequence[str], states: DataFrame | None = None) -> DataFrame:
    """Missing and infinite cells per feature, with a valid/warnings status."""
    warned = F.when((F.col("nan_count") > 0) | (F.col("inf_count") > 0), "warnings").otherwise("valid")
    return column_summary(states or measured(df, columns, bins=False), columns).select(
        "feature", "rows", "nan_count", "inf_count", F.round(100 * F.col("nan_count") / F.col("rows"), 4).alias("nan_pct"), warned.alias("status")
    )


def extreme_counts(df: DataFrame, columns: Sequence[str], fraction: float = 0.01, states: DataFrame | None = None) -> DataFrame:
    """Cells outside the [p, 1-p] quantiles per feature, counted where those are found."""
    states = states or measured(df, columns)
    ranks = order_statistics(states, df, columns, [fraction, 1 - fraction])
    outside = (F.get("below", F.lit(0)) + F.get("above", F.lit(1))).alias("extreme_count")
    known = column_summary(states, columns).select("feature").join(ranks.select("feature", outside), "feature", "left")
    return known.select("feature", F.coalesce("extreme_count", F.lit(0)).alias("extreme_count"))


def zscore_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 6.0) -> DataFrame:
    """Cells further than ``threshold`` sample deviations from the mean."""
    # One row for each column.
    moments = {r["feature"]: (r["mean"], r["std"]) for r in column_summary(measured(df, columns, bins=False), columns).collect()}

    def far(c: str) -> Column:
        mean, spread = moments[c]
        if mean is None or spread is None or not spread > ROUNDING * abs(mean):
            return F.lit(False)
        return F.abs((finite(c) - F.lit(mean)) / F.lit(spread)) > threshold

    if not moments:
        return df.select(F.lit("").alias("feature"), F.lit(0).cast("long").alias("outliers")).limit(0)
    wide = df.agg(*(count_if(far(c)).alias(c) for c in columns))
    return wide.unpivot([], list(columns), "feature", "outliers")


def quality_metrics(df: DataFrame, columns: Sequence[str], min_non_na: float = 0.95, states: DataFrame | None = None) -> DataFrame:
    """Completeness, moments, tails, PASS/FAIL and score per feature."""
    states = states or measured(df, columns)
    ranks = order_statistics(states, df, columns, [0.01, 0.5, 0.99]).select("feature", "quantiles")
    stats = column_summary(states, columns).join(ranks, "feature", "left").withColumn("non_na_pct", F.col("count") / F.col("rows"))
    return stats.select(
        "feature", "non_na_pct", "mean", "std", "min", "max",
        *(F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("p1", "p50", "p99"))),
        F.when(F.col("non_na_pct") >= min_non_na, "PASS").otherwise("FAIL").alias("status"),
        F.greatest(F.lit(0.0), F.col("non_na_pct") / min_non_na).alias("score"),
    )


def with_quality(metadata: DataFrame, metrics: DataFrame) -> DataFrame:
    """Feature metadata with its quality status; UNKNOWN where none was measured."""
    # Both tables hold one row per feature.
    return metadata.join(metrics.withColumnRenamed("feature", "name"), "name", "left").withColumn(
        "status", F.coalesce("status", F.lit("UNKNOWN"))
    )


def feature_set_gate(
    df: DataFrame, expected: Sequence[str], min_non_na: float = 0.95
) -> DataFrame:
    """One verdict: expected features present, complete enough, keys unique."""
    absent = [c for c in expected if c not in df.columns]
    present = [c for c in expected if c in df.columns]
    cells = quality_metrics(df, present, min_non_na).agg(
        F.count("*").alias("measured"), count_if(F.col("status") == "FAIL").alias("incomplete")
    )
    keys = df.groupBy("symbol", "ts").agg((F.count("*") - 1).alias("e")).agg(
        F.sum("e").alias("duplicates"), F.sum(F.col("e") + 1).alias("rows")
    )
    one = F.lit(1).alias("_one")
    return (
        cells.select("*", one)
        .join(keys.select("*", one), "_one")
        .select(
            F.col("rows"),
            F.lit(len(expected)).alias("expected_features"),
            F.lit(len(absent)).alias("missing_features"),
            "incomplete",
            "duplicates",
            F.when(
                (F.lit(len(absent)) == 0) & (F.col("incomplete") == 0) & (F.col("duplicates") == 0), "PASS"
            ).otherwise("FAIL").alias("verdict"),
        )
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str], states: DataFrame | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation for every column pair (i < j).

    Each task reduces its rows to one p x p block of moments about its own means, so the frame is computed
    once and only tasks * p^2 / 2 rows are shuffled whatever the number of bars.
    """
    return correlations(states or measured(df, columns, pairs=True, bins=False), columns, ROUNDING)


def high_correlations(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pairs.where(F.abs("correlation") > threshold)


def variance_ranking(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` features by sample variance."""
    stats = column_summary(measured(df, columns, bins=False), columns)
    return stats.select("feature", (F.col("std") * F.col("std")).alias("variance")).orderBy(F.desc_nulls_last("variance"), "feature").limit(top)


def analysis_summary(df: DataFrame, columns: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Rows, symbols, features, overall missing percentage, highly correlated pairs."""
    cells = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    summary = df.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(cells).alias("missing")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("symbols"), F.sum("missing").alias("missing_cells")
    )
    width = len(columns)
    summary = summary.withColumns(
        {
            "features": F.lit(width),
            "missing_pct": F.round(100 * F.col("missing_cells") / (F.col("rows") * width), 4),
        }
    )
    if pairs is None:
        return summary
    one = F.lit(1).alias("_one")
    strong = high_correlations(pairs).agg(F.count("*").alias("high_correlation_pairs"))
    return summary.select("*", one).join(strong.select("*", one), "_one").drop("_one")


def anomalies(df: DataFrame, columns: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Cells outside the expected range of their feature.

    ``ranges``: feature, expected_low, expected_high (a NULL bound is open).
    """
    cells = long_form(df, columns, ["symbol", "ts"])
    low = F.col("value") < F.col("expected_low")
    high = F.col("value") > F.col("expected_high")
    bad = F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))
    return join_small(cells, ranges, ["feature"], "inner").where(bad)


def family_columns(metadata: DataFrame, family: str) -> list[str]:
    """Feature names of one family (the metadata table has one row per feature)."""
    return [r["name"] for r in metadata.where(F.col("family") == family).select("name").orderBy("name").collect()]


def expected_features_missing(metadata: DataFrame, df: DataFrame) -> DataFrame:
    """Metadata rows whose feature is not a column of ``df``."""
    have = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    return metadata.join(F.broadcast(have), "name", "left_anti")
