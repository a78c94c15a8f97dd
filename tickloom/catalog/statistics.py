"""Statistics, gate and correlations over every feature of the frame, beside the small set in ``quality``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.features import _HIGH_VOL, CFG, FAMILY_OF, FRAME_PARTS
from tickloom.catalog.quality import _METRICS, _RANGES, r6
from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import TICK_BARS, rnd
from tickloom.operators import feature_qc as fq
from tickloom.operators.features import compute_features
from tickloom.session import stored
from tickloom.sources.tables import tick_bars

COLUMNS = sorted(FAMILY_OF)


def _cells_sql() -> str:
    """CTE ``cells``: symbol, ts, feature, value of every feature, nulls included."""
    high = {f"high_volatility_{n}": f"high_volatility_{n}" for n in CFG.volatility}
    tables, cells = [], []
    for i, (columns, base) in enumerate([*FRAME_PARTS, (high, _HIGH_VOL.replace(f"WITH {TICK_BARS}, ", "WITH "))]):
        values = ", ".join(f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in columns.items())
        tables.append(f"p{i} AS (SELECT symbol, ts, {values} FROM ({base}))")
        cells.append(f"SELECT symbol, ts, feature, value FROM p{i} UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(columns)}))")
    return f"WITH {TICK_BARS}, {', '.join(tables)}, cells AS MATERIALIZED ({' UNION ALL '.join(cells)})"


def _varies(a: str, b: str) -> str:
    both = f"FILTER ({b}.value IS NOT NULL)"
    return f"stddev_pop({a}.value) {both} > {fq.ROUNDING!r} * abs(avg({a}.value) {both})"


_ALL = _cells_sql()
_PLACE = f"place(feature, i) AS (VALUES {', '.join(f'({c!r}, {i})' for i, c in enumerate(COLUMNS))})"
_PAIRS = f"""{_PLACE}, placed AS (SELECT * FROM cells JOIN place USING (feature)),
  pairs AS (SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) FILTER (a.value IS NOT NULL AND b.value IS NOT NULL) AS n,
    {rnd(f"CASE WHEN {_varies('a', 'b')} AND {_varies('b', 'a')} THEN corr(a.value, b.value) END")} AS correlation FROM placed a JOIN placed b ON a.symbol = b.symbol AND a.ts = b.ts AND a.i < b.i GROUP BY 1, 2)"""


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_features(tick_bars(spark, sf_dir), CFG).select("symbol", "ts", *COLUMNS)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, computed once for statistics that read them several times."""
    return stored(all_features(spark, sf_dir), "features")


def _pairs(feats: DataFrame) -> DataFrame:
    return r6(fq.correlation_pairs(feats, COLUMNS), "correlation")


@query(
    "describe_features_all",
    f"""{_ALL} SELECT feature, count(value) AS count, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std, {rnd('min(value)')} AS min,
    {rnd('quantile_cont(value, 0.25)')} AS p25, {rnd('quantile_cont(value, 0.5)')} AS p50, {rnd('quantile_cont(value, 0.75)')} AS p75,
    {rnd('max(value)')} AS max FROM cells GROUP BY 1""",
)
def describe_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.describe(stored_features(spark, sf_dir), COLUMNS), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "feature_ranges_all",
    f"""{_ALL} SELECT feature, {rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('avg(value)')} AS mean,
    {rnd('stddev_samp(value)')} AS std, count(*) FILTER (value IS NULL) AS nan_count FROM cells GROUP BY 1""",
)
def feature_ranges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.feature_ranges(all_features(spark, sf_dir), COLUMNS), "min", "max", "mean", "std")


@query(
    "nan_inf_counts_all",
    f"""{_ALL} SELECT feature, count(*) AS rows, count(*) FILTER (value IS NULL) AS nan_count, CAST(0 AS BIGINT) AS inf_count,
    round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS nan_pct,
    CASE WHEN count(*) FILTER (value IS NULL) > 0 THEN 'warnings' ELSE 'valid' END AS status FROM cells GROUP BY 1""",
)
def nan_inf_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.missing_counts(all_features(spark, sf_dir), COLUMNS)


@query(
    "extreme_counts_all",
    f"""{_ALL}, q AS (SELECT feature, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM cells GROUP BY 1)
    SELECT feature, count(*) FILTER (value < a OR value > b) AS extreme_count FROM cells JOIN q USING (feature) GROUP BY 1""",
)
def extreme_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.extreme_counts(stored_features(spark, sf_dir), COLUMNS)


_MOMENTS = "m AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM cells GROUP BY 1)"


@query(
    "zscore_outliers_all",
    f"{_ALL}, {_MOMENTS} SELECT feature, count(*) FILTER (s > {fq.ROUNDING!r} * abs(m) AND abs(value - m) / s > 6) AS outliers FROM cells JOIN m USING (feature) GROUP BY 1",
)
def zscore_outliers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.zscore_outliers(stored_features(spark, sf_dir), COLUMNS)


@query("quality_metrics_all", f"{_ALL} {_METRICS}")
def quality_metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fq.quality_metrics(stored_features(spark, sf_dir), COLUMNS)
    return r6(df, "non_na_pct", "mean", "std", "p1", "p50", "p99", "score").drop("min", "max")


@query(
    "quality_gate_all",
    f"""{_ALL}, m AS ({_METRICS}), s AS (SELECT count(*) FILTER (status = 'FAIL') AS incomplete,
      (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, ts)) AS duplicates FROM m)
    SELECT (SELECT count(*) FROM raw) AS rows, {len(COLUMNS)} AS expected_features, 0 AS missing_features, incomplete, duplicates,
    CASE WHEN incomplete = 0 AND duplicates = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s""",
)
def quality_gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.feature_set_gate(stored_features(spark, sf_dir), COLUMNS)


@query("corr_pairs_all", f"{_ALL}, {_PAIRS} SELECT * FROM pairs")
def corr_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(all_features(spark, sf_dir))


@query("high_correlations_all", f"{_ALL}, {_PAIRS} SELECT feature_a, feature_b, correlation FROM pairs WHERE abs(correlation) > 0.8")
def high_correlations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.high_correlations(_pairs(all_features(spark, sf_dir))).select("feature_a", "feature_b", "correlation")


@query(
    "variance_topk_all",
    f"{_ALL} SELECT feature, {rnd('var_samp(value)')} AS variance FROM cells GROUP BY 1 ORDER BY var_samp(value) DESC NULLS LAST, feature LIMIT 10",
)
def variance_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.variance_ranking(all_features(spark, sf_dir), COLUMNS), "variance")


@query(
    "analysis_summary_all",
    f"""{_ALL}, {_PAIRS} SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(DISTINCT symbol) FROM raw) AS symbols,
    count(*) FILTER (value IS NULL) AS missing_cells, {len(COLUMNS)} AS features, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS missing_pct,
    (SELECT count(*) FROM pairs WHERE abs(correlation) > 0.8) AS high_correlation_pairs FROM cells""",
)
def analysis_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stored_features(spark, sf_dir)
    return fq.analysis_summary(feats, COLUMNS, _pairs(feats))


_GIVEN = {name: (low, high) for name, low, high in _RANGES}
_GIVEN_SQL = ", ".join(f"('{name}', CAST({low} AS DOUBLE), CAST({'NULL' if high is None else high} AS DOUBLE))" for name, low, high in _RANGES)


@query(
    "anomaly_report_all",
    f"""{_ALL}, {_MOMENTS}, given(feature, low, high) AS (VALUES {_GIVEN_SQL}),
    r AS (SELECT * FROM given UNION ALL SELECT feature, m - 6 * s, m + 6 * s FROM m WHERE s > {fq.ROUNDING!r} * abs(m) AND feature NOT IN (SELECT feature FROM given))
    SELECT symbol, ts, feature, {rnd('value')} AS value FROM cells JOIN r USING (feature) WHERE value < low OR value > high""",
)
def anomaly_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without a given range are expected within six deviations of their mean."""
    feats = stored_features(spark, sf_dir)
    given = spark.createDataFrame(_RANGES, "feature string, expected_low double, expected_high double")
    m, s = F.col("mean"), F.col("std")
    usual = fq.feature_ranges(feats, [c for c in COLUMNS if c not in _GIVEN]).where(s > fq.ROUNDING * F.abs(m)).select(
        "feature", (m - 6 * s).alias("expected_low"), (m + 6 * s).alias("expected_high")
    )
    found = fq.anomalies(feats, COLUMNS, given.unionByName(usual))
    return r6(found.select("symbol", "ts", "feature", "value"), "value")


@query(
    "metadata_quality_all",
    f"""{_ALL}, m AS ({_METRICS}), meta(name, family) AS (VALUES {', '.join(str(x) for x in FAMILY_OF.items())})
    SELECT name, family, coalesce(status, 'UNKNOWN') AS status, non_na_pct FROM meta LEFT JOIN m ON name = feature""",
)
def metadata_quality_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame(list(FAMILY_OF.items()), "name string, family string")
    metrics = fq.quality_metrics(stored_features(spark, sf_dir), COLUMNS)
    return r6(fq.with_quality(meta, metrics), "non_na_pct").select("name", "family", "status", "non_na_pct")


_CHOSEN = "volume_liquidity"


@query(
    "family_selection",
    f"""{_ALL} SELECT feature, count(value) AS n, {rnd('avg(value)')} AS mean FROM cells
    WHERE feature IN ({', '.join(repr(c) for c in COLUMNS if FAMILY_OF[c] == _CHOSEN)}) GROUP BY 1""",
)
def family_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of one family, as the metadata table names them."""
    metadata = spark.createDataFrame(sorted(FAMILY_OF.items()), "name string, family string")
    chosen = fq.family_columns(metadata, _CHOSEN)
    cells = fq.long_form(all_features(spark, sf_dir).select(*chosen), chosen)
    return r6(cells.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), "mean")
