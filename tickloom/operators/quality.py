"""Coverage, gaps, validation rules and quality reports over bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import QualityConfig
from tickloom.functions.numeric import count_if, ratio
from tickloom.operators.normalize import OHLCV, ohlc_rules
from tickloom.plans.slices import slice_series
from tickloom.plans.small import join_small


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of ``right`` beside those of ``left`` with the same ``key``, null included."""
    other = right.withColumnRenamed(key, "_key")
    return left.join(other, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def quality_report(bars: DataFrame) -> DataFrame:
    """One row per symbol (rows without one are reported, too): size, time range, nulls, duplicates, rule violations, sources."""
    rules = {f"n_{name}": count_if(broken) for name, broken in ohlc_rules().items()}
    nulls = {f"null_{c}": count_if(F.col(c).isNull()) for c in OHLCV}
    base = bars.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        count_if(F.col("volume") < 0).alias("n_negative_volume"),
        *(value.alias(name) for name, value in {**nulls, **rules}.items()),
    )
    duplicates = (
        bars.groupBy("symbol", "ts")
        .agg((F.count("*") - 1).alias("extra"))
        .groupBy("symbol")
        .agg(F.sum("extra").alias("duplicate_ts"))
    )
    report = _beside(base, duplicates, "symbol")
    if "source" in bars.columns:
        # Two-level: counts per (symbol, source) first, so the map stays small.
        sources = (
            bars.groupBy("symbol", "source")
            .agg(F.count("*").alias("n"))
            .groupBy("symbol")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"))
        )
        report = _beside(report, sources, "symbol")
    if "load_id" in bars.columns:
        loads = bars.select("symbol", "load_id").distinct().groupBy("symbol").agg(F.count("*").alias("load_ids"))
        report = _beside(report, loads, "symbol")
    return report


def coverage(bars: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """Per symbol: expected slots between first and last bar, actual, percentage.

    Undefined (NULL) for a single bar.
    """
    cfg = cfg or QualityConfig()
    span = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    stats = bars.groupBy("symbol").agg(
        F.count("*").alias("actual"),
        (F.floor(span / (60 * cfg.bar_minutes)) + 1).alias("expected"),
    )
    pct = F.round(100 * F.col("actual") / F.col("expected"), 2)
    return stats.select(
        "symbol",
        "expected",
        "actual",
        F.when(F.col("actual") > 1, pct).alias("coverage_pct"),
        F.when(F.col("actual") > 1, pct >= cfg.min_coverage_pct).alias("meets_threshold"),
    )


def daily_coverage(bars: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """Per (symbol, date): expected and actual bars, percentage, status."""
    cfg = cfg or QualityConfig()
    expected = 1440 // cfg.bar_minutes
    pct = F.round(100 * F.col("actual") / expected, 2)
    return (
        bars.groupBy("symbol", F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("actual"))
        .withColumns({"expected": F.lit(expected), "coverage_pct": pct})
        .withColumn(
            "status",
            F.when(F.col("coverage_pct") < cfg.critical_coverage_pct, "CRITICAL")
            .when(F.col("coverage_pct") < cfg.warning_coverage_pct, "WARNING")
            .otherwise("PASS"),
        )
    )


def run_summary(report: DataFrame, expected_symbols: Sequence[str] | None = None) -> DataFrame:
    """Totals over a quality report: symbols seen, missing, rows, rows with defects."""
    defects = sum(
        (F.col(c) for c in report.columns if c.startswith("n_")), F.lit(0).cast("long")
    )
    total = F.lit(len(expected_symbols)) if expected_symbols is not None else F.count("*")
    return report.agg(
        total.cast("long").alias("total_symbols"),
        F.count("*").alias("successful"),
        (total - F.count("*")).cast("long").alias("failed"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(defects), F.lit(0)).alias("total_defects"),
    )


def consolidation_summary(bars: DataFrame, feature_columns: Sequence[str] = ()) -> DataFrame:
    """Rows, time range and distinct dates per symbol, with the feature count."""
    return (
        bars.groupBy("symbol", F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
        .groupBy("symbol")
        .agg(
            F.sum("n").alias("rows"),
            F.min("a").alias("ts_min"),
            F.max("b").alias("ts_max"),
            F.count("*").alias("dates"),
        )
        .withColumn("feature_columns", F.lit(len(feature_columns)))
    )


def gaps(
    bars: DataFrame, cfg: QualityConfig | None = None, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Holes between consecutive bars: missing slots, length, severity."""
    cfg = cfg or QualityConfig()
    series = slice_series(
        bars.select("symbol", "ts"), ["symbol"], ["ts"], lookback=1, rows_per_slice=rows_per_slice
    )
    df = series.df.withColumn("gap_start", F.lag("ts").over(series.window))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("gap_start").cast("timestamp"))
    step = 60 * cfg.bar_minutes
    found = df.withColumn("gap_minutes", seconds / 60).where(seconds > step)
    severity = (
        F.when(F.col("gap_minutes") >= 60 * cfg.alert_gap_hours, "ALERT")
        .when(F.col("gap_minutes") > cfg.max_gap_minutes, "WARNING")
        .otherwise("INFO")
    )
    out = found.withColumns(
        {"missing_bars": F.floor(F.col("gap_minutes") / cfg.bar_minutes).cast("long") - 1, "severity": severity}
    )
    return series.owned(out).select(
        "symbol", "gap_start", F.col("ts").alias("gap_end"), "gap_minutes", "missing_bars", "severity"
    )


def calendar(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Every expected slot per symbol between its first and last bar.

    Expanded in two steps, day ranges then slots of a day, and spread in
    between, so one symbol's long history is not generated by one task.
    """
    bounds = bars.groupBy("symbol").agg(
        F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a"),
        F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("b"),
    )
    block = 1440 * 60
    step = minutes * 60
    blocks = bounds.select(
        "symbol", "a", "b", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit((block // step) * step))).alias("start")
    ).repartition("symbol", "start")
    stop = F.least(F.col("b"), F.col("start") + (block // step) * step - step)
    return blocks.select(
        "symbol", F.explode(F.sequence(F.col("start"), stop, F.lit(step))).alias("s")
    ).select("symbol", F.timestamp_seconds("s").alias("ts"))


def missing_slots(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Expected slots without a bar."""
    have = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"))
    return calendar(bars, minutes).join(have, ["symbol", "ts"], "left_anti")


def price_jumps(
    bars: DataFrame, cfg: QualityConfig | None = None, *, rows_per_slice: int | None = None
) -> DataFrame:
    """Bars whose close moved by more than the allowed fraction."""
    cfg = cfg or QualityConfig()
    series = slice_series(
        bars.select("symbol", "ts", "close"), ["symbol"], ["ts"], lookback=1, rows_per_slice=rows_per_slice
    )
    change = ratio("close", F.lag("close").over(series.window)) - 1
    df = series.df.withColumn("change", change).where(F.abs("change") > cfg.max_price_change)
    return series.owned(df)


# --- rule results: (check, level, failed, message) -------------------------------------------

RESULT = "check string, level string, failed bigint, message string"


def _result(check: str, level: str, failed: Column, message: str) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(level).alias("level"),
        failed.cast("long").alias("failed"),
        F.when(failed > 0, F.concat(failed.cast("string"), F.lit(f" {message}"))).alias("message"),
    )


def _as_rows(stats: DataFrame, results: Sequence[Column]) -> DataFrame:
    """One aggregate row to one row per check."""
    return stats.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def validate_frame(
    df: DataFrame,
    required: Sequence[str] = (),
    dtypes: Mapping[str, str] | None = None,
    min_rows: int = 1,
    max_rows: int | None = None,
) -> DataFrame:
    """Structure checks: emptiness, columns, types, row limits, duplicates, nulls."""
    present = dict(df.dtypes)
    missing = [c for c in required if c not in present]
    wrong = [c for c, t in (dtypes or {}).items() if c in present and present[c] != t]
    stats = df.agg(F.count("*").alias("rows"), *(count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns))
    one = F.lit(1).alias("_one")
    stats = stats.select("*", one).join(duplicate_count(df).select("duplicates", one), "_one").drop("_one")
    rows = F.col("rows")
    results = [
        _result("not_empty", "error", F.when(rows == 0, 1).otherwise(0), "empty input"),
        _result("required_columns", "error", F.lit(len(missing)), f"missing columns: {missing}"),
        _result("column_types", "error", F.lit(len(wrong)), f"columns of another type: {wrong}"),
        _result("min_rows", "error", F.greatest(F.lit(min_rows) - rows, F.lit(0)), "rows too few"),
        _result("duplicate_rows", "warning", F.col("duplicates"), "duplicate rows"),
        *(_result(f"null_{c}", "warning", F.col(f"null_{c}"), f"nulls in {c}") for c in df.columns),
    ]
    if max_rows is not None:
        results.append(_result("max_rows", "error", F.greatest(rows - max_rows, F.lit(0)), "rows too many"))
    return _as_rows(stats, results)


def duplicate_count(df: DataFrame) -> DataFrame:
    """``duplicates``: rows beyond the first of each set of equal rows, without moving rows that have no equal.

    First only a hash of each row is counted, on the map side already. Rows whose hash occurs again are then compared
    whole, so a clash of hashes counts for nothing.
    """
    kinds = dict(df.dtypes)
    # Zero and minus zero are one value, as in grouping.
    plain = lambda c: F.col(f"`{c}`") + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    hashed = df.select(F.xxhash64(*(plain(c) for c in df.columns)).alias("_hash"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)))
    again = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    suspects = join_small(hashed, again, ["_hash"], "inner")
    copies = suspects.groupBy(*(f"_c{i}" for i in range(len(df.columns)))).agg((F.count("*") - 1).alias("e"))
    return copies.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("duplicates"))


def validate_timestamps(
    df: DataFrame,
    now: datetime | Column,
    ts: str = "ts",
    key: str = "symbol",
    arrival: str | None = None,
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Type, future, duplicate and order checks.

    Order is only checkable where ``arrival`` records the order rows came in;
    sorting by the timestamp itself first would make the check vacuous.
    """
    limit = now if isinstance(now, Column) else F.lit(now)
    temporal = dict(df.dtypes)[ts].startswith(("timestamp", "date"))
    duplicates = (
        df.groupBy(key, ts).agg((F.count("*") - 1).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("duplicates"))
    )
    stats = df.agg(
        count_if(F.col(ts).isNull()).alias("missing"), count_if(F.col(ts) > limit).alias("future")
    ).withColumn("_one", F.lit(1)).join(duplicates.withColumn("_one", F.lit(1)), "_one")
    results = [
        _result("timestamp_type", "error", F.lit(0 if temporal else 1), "column is not a timestamp"),
        _result("null_timestamps", "error", F.col("missing"), "null timestamps"),
        _result("future_timestamps", "error", F.col("future"), "future timestamps"),
        _result("duplicate_timestamps", "warning", F.col("duplicates"), "duplicate (symbol, ts)"),
    ]
    if arrival is not None:
        series = slice_series(df, [key], [arrival], lookback=1, rows_per_slice=rows_per_slice)
        stepped = series.owned(series.df.withColumn("_before", F.lag(ts).over(series.window)))
        disorder = stepped.agg(count_if(F.col(ts) < F.col("_before")).alias("disorder"))
        stats = stats.join(disorder.withColumn("_one", F.lit(1)), "_one")
        results.append(_result("monotonic_timestamps", "error", F.col("disorder"), "rows out of order"))
    return _as_rows(stats, results)


def validate_ohlcv(df: DataFrame, price_columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Price and volume rule counts over the whole frame."""
    rules = ohlc_rules()
    if tuple(price_columns) != ("open", "high", "low", "close"):
        broken = F.lit(False)
        for c in price_columns:
            broken = broken | (F.col(c) <= 0)
        rules = {"non_positive_price": broken}
    stats = df.agg(
        *(count_if(broken).alias(name) for name, broken in rules.items()),
        count_if(F.col("volume") < 0).alias("negative_volume"),
    )
    return _as_rows(
        stats,
        [_result(name, "error", F.col(name), name.replace("_", " ")) for name in (*rules, "negative_volume")],
    )


def price_statistics(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    """Min, max and mean per price/volume column."""
    return (
        df.select(*(F.col(c).cast("double") for c in columns))
        .unpivot([], list(columns), "column", "value")
        .groupBy("column")
        .agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    )


def roll_up(results: DataFrame) -> DataFrame:
    """Totals over rule results: checks, passed, success rate, messages."""
    messages = lambda level: F.array_sort(
        F.collect_list(F.when((F.col("level") == level) & (F.col("failed") > 0), F.col("message")))
    )
    passed = count_if((F.col("failed") == 0) | (F.col("level") == "warning"))
    return results.agg(
        F.count("*").alias("total_checks"),
        passed.alias("passed_checks"),
        F.round(100 * passed / F.count("*"), 2).alias("success_rate"),
        messages("error").alias("errors"),
        messages("warning").alias("warnings"),
    )


class ValidationError(ValueError):
    """Raised by :func:`require_valid`."""


def require_valid(results: DataFrame) -> None:
    """Strict mode: raise when any error-level check failed (a handful of rows)."""
    failed = results.where((F.col("level") == "error") & (F.col("failed") > 0)).collect()
    if failed:
        raise ValidationError("; ".join(row["message"] for row in failed))


def partition_validity(
    df: DataFrame,
    by: str,
    min_rows: int = 1,
    now: datetime | Column | None = None,
    arrival: str | None = None,
    unique: bool = False,
    *,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Per file or partition: structure, timestamps, prices, status. A null partition or symbol is one like any other.

    Timestamps are good if none is null and, as far as asked for, none lies after ``now``, none repeats
    within its symbol (``unique``), and none is earlier than the row before it in the order of ``arrival``.
    """
    broken = F.lit(False)
    for rule in ohlc_rules().values():
        broken = broken | F.coalesce(rule, F.lit(False))
    missing = F.lit(False)
    for c in OHLCV:
        missing = missing | F.col(c).isNull()
    bad_price = count_if(broken | F.coalesce(F.col("volume") < 0, F.lit(False)))
    extra = (
        df.groupBy(by, "symbol", "ts").agg((F.count("*") - 1).alias("e")).groupBy(by).agg(F.sum("e").alias("duplicates"))
    )
    counts = [
        F.count("*").alias("rows"),
        count_if(missing).alias("null_rows"),
        bad_price.alias("bad_ohlcv"),
        count_if(F.col("ts").isNull()).alias("null_ts"),
    ]
    timely = F.col("null_ts") == 0
    if now is not None:
        counts.append(count_if(F.col("ts") > (now if isinstance(now, Column) else F.lit(now))).alias("future"))
        timely = timely & (F.col("future") == 0)
    table = _beside(df.groupBy(by).agg(*counts), extra, by)
    if unique:
        timely = timely & (F.col("duplicates") == 0)
    if arrival is not None:
        series = slice_series(df.select(by, "symbol", "ts", arrival), [by, "symbol"], [arrival], lookback=1, rows_per_slice=rows_per_slice)
        stepped = series.owned(series.df.withColumn("_before", F.lag("ts").over(series.window)))
        table = _beside(table, stepped.groupBy(by).agg(count_if(F.col("ts") < F.col("_before")).alias("disorder")), by)
        timely = timely & (F.col("disorder") == 0)
    table = table.withColumns(
        {
            "structure_ok": (F.col("rows") >= min_rows) & (F.col("null_rows") == 0),
            "timestamps_ok": timely,
            "ohlcv_ok": F.col("bad_ohlcv") == 0,
        }
    )
    valid = F.col("structure_ok") & F.col("timestamps_ok") & F.col("ohlcv_ok")
    return table.withColumn("status", F.when(valid, "valid").otherwise("invalid"))


def dataset_status(features: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """Rows, symbols, features and date range of a feature table."""
    return features.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
    ).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("symbols"),
        F.lit(len(feature_columns)).alias("features"),
        F.min("a").alias("ts_min"),
        F.max("b").alias("ts_max"),
    )
