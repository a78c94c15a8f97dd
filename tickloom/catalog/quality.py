"""Ingest, quality-control and feature-statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import HOURLY_BARS, TICK_BARS, VOLUME, full, lag, rnd
from tickloom.config import FeatureConfig, QualityConfig
from tickloom.functions.numeric import count_if, rounded
from tickloom.operators import feature_qc as fq
from tickloom.operators import normalize as nz
from tickloom.operators import quality as qc
from tickloom.operators.features import compute_features
from tickloom.sources.readers import klines_from_text
from tickloom.sources.tables import daily_bars, hourly_bars, table, tick_bars

HOURLY = QualityConfig(bar_minutes=60, source_priority=("dump", "rest"))


def ntz(df: DataFrame) -> DataFrame:
    """Zone-less timestamps, like the stored tables."""
    return df.select(
        *(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in df.dtypes)
    )


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in columns})


@query("bars_hourly", f"WITH {HOURLY_BARS} SELECT * FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_bars(spark, sf_dir)


@query(
    "bars_daily",
    """WITH d AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
       row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o, l_quantity FROM lineitem)
       SELECT symbol, ts, round(arg_min(price, o), 8) AS open, round(max(price), 8) AS high, round(min(price), 8) AS low,
       round(arg_max(price, o), 8) AS close, sum(l_quantity) AS volume FROM d GROUP BY 1, 2""",
)
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).withColumns(
        {c: rounded(c, 8) for c in ("open", "high", "low", "close")}
    )


# Raw bars with defects: every tick as a raw record whose fields go wrong by value band.
_RAW_SQL = f"""rawbars AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS open,
  CASE WHEN {VOLUME} >= 95 THEN value * 0.5 ELSE value * 1.5 END AS high,
  CASE WHEN {VOLUME} = 7 THEN value * 1.25 ELSE value * 0.5 END AS low,
  CASE WHEN {VOLUME} = 3 THEN -value WHEN {VOLUME} = 4 THEN NULL ELSE value END AS close,
  CASE WHEN {VOLUME} = 5 THEN -1.0 ELSE {VOLUME} END AS volume,
  CASE WHEN user_id % 2 = 0 THEN 'dump' ELSE 'rest' END AS source, CAST(event_id AS VARCHAR) AS load_id FROM events)"""
_REASON = """CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'null_ohlcv'
  WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non_positive_price' WHEN high < low THEN 'high_below_low'
  WHEN open > high OR open < low THEN 'open_out_of_range' WHEN close > high OR close < low THEN 'close_out_of_range'
  WHEN volume < 0 THEN 'volume_below_minimum' WHEN ts > TIMESTAMP '2024-01-29 00:00:00' THEN 'future_timestamp' END"""
NOW = "2024-01-29 00:00:00"


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"),
        value.alias("open"),
        F.when(k >= 95, value * 0.5).otherwise(value * 1.5).alias("high"),
        F.when(k == 7, value * 1.25).otherwise(value * 0.5).alias("low"),
        F.when(k == 3, -value).when(k != 4, value).alias("close"),
        F.when(k == 5, -1.0).otherwise(k).alias("volume"),
        F.when(F.col("user_id") % 2 == 0, "dump").otherwise("rest").alias("source"),
        F.col("event_id").cast("string").alias("load_id"),
    )


def _normalized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = raw_bars(spark, sf_dir)
    return nz.normalize(raw, F.lit(NOW).cast("timestamp"), HOURLY)


@query(
    "bars_normalized",
    f"""WITH {_RAW_SQL}, good AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY source, load_id) AS rn
    FROM rawbars WHERE ({_REASON}) IS NULL)
    SELECT symbol, ts, open, {rnd('high')} AS high, {rnd('low')} AS low, close, volume, source, load_id FROM good WHERE rn = 1""",
)
def bars_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, _ = _normalized(spark, sf_dir)
    return ntz(r6(clean, "high", "low")).drop("spread_est", "ingestion_ts")


@query(
    "bars_quarantine",
    f"WITH {_RAW_SQL} SELECT symbol, {_REASON} AS reject_reason, count(*) AS n FROM rawbars WHERE ({_REASON}) IS NOT NULL GROUP BY 1, 2",
)
def bars_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = _normalized(spark, sf_dir)
    return rejected.groupBy("symbol", "reject_reason").agg(F.count("*").alias("n"))


@query(
    "bars_valid_filter",
    f"WITH {TICK_BARS} SELECT symbol, ts, close, volume FROM raw WHERE open > 0 AND high >= low AND close BETWEEN low AND high AND open BETWEEN low AND high AND volume >= 10",
)
def bars_valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = nz.reject_reason(cfg=QualityConfig(min_volume=10))
    return tick_bars(spark, sf_dir).where(reason.isNull()).select("symbol", "ts", "close", "volume")


@query("bars_dedup", f"WITH {HOURLY_BARS} SELECT symbol, ts, close, 'dump' AS source FROM bars")
def bars_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", "close")
    both = bars.withColumn("source", F.lit("rest")).unionByName(bars.withColumn("source", F.lit("dump")))
    return nz.deduplicate(both, HOURLY, tiebreak=("close",))


@query(
    "select_bars",
    f"WITH {HOURLY_BARS} SELECT symbol, ts, close FROM bars WHERE symbol IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'",
)
def select_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    return nz.select_bars(bars, ["click", "view"], "2024-01-05", "2024-01-10").select("symbol", "ts", "close")


@query(
    "holdout_split",
    f"""WITH {HOURLY_BARS} SELECT CASE WHEN ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' THEN 'holdout' ELSE 'train' END AS part,
    symbol, count(*) AS n, {rnd('sum(volume)')} AS volume FROM bars GROUP BY 1, 2""",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = nz.holdout_split(hourly_bars(spark, sf_dir), "2024-01-20", "2024-01-25")
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))
    return both.groupBy("part", "symbol").agg(F.count("*").alias("n"), rounded(F.sum("volume")).alias("volume"))


@query(
    "quality_report",
    f"""WITH {_RAW_SQL}, d AS (SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicate_ts FROM
      (SELECT symbol, ts, count(*) AS n FROM rawbars GROUP BY 1, 2) GROUP BY 1)
    SELECT symbol, count(*) AS rows, min(ts) AS ts_min, max(ts) AS ts_max, count(*) FILTER (close IS NULL) AS null_close,
      count(*) FILTER (volume < 0) AS n_negative_volume,
      count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS n_non_positive_price,
      count(*) FILTER (high < low) AS n_high_below_low, count(*) FILTER (open > high OR open < low) AS n_open_out_of_range,
      count(*) FILTER (close > high OR close < low) AS n_close_out_of_range, any_value(duplicate_ts) AS duplicate_ts,
      count(*) FILTER (source = 'dump') AS from_dump, count(*) FILTER (source = 'rest') AS from_rest, count(DISTINCT load_id) AS load_ids
    FROM rawbars JOIN d USING (symbol) GROUP BY symbol""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_bars(spark, sf_dir).withColumn("ts", nz.to_minute("open_time"))
    report = qc.quality_report(raw).withColumns(
        {"from_dump": F.col("sources")["dump"], "from_rest": F.col("sources")["rest"]}
    )
    return ntz(report.drop("sources", "null_open", "null_high", "null_low", "null_volume"))


@query(
    "quality_run_summary",
    f"""WITH {_RAW_SQL} SELECT CAST(6 AS BIGINT) AS total_symbols, count(DISTINCT symbol) AS successful, 6 - count(DISTINCT symbol) AS failed,
    count(*) AS total_rows, count(*) FILTER (volume < 0) + count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0)
    + count(*) FILTER (high < low) + count(*) FILTER (open > high OR open < low) + count(*) FILTER (close > high OR close < low) AS total_defects
    FROM rawbars""",
)
def quality_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_bars(spark, sf_dir).withColumn("ts", nz.to_minute("open_time"))
    return qc.run_summary(qc.quality_report(raw), ["click", "view", "error", "signup", "purchase", "refund"])


@query(
    "coverage_by_symbol",
    f"""WITH {HOURLY_BARS}, c AS (SELECT symbol, count(*) AS actual, date_diff('hour', min(ts), max(ts)) + 1 AS expected FROM bars GROUP BY 1)
    SELECT symbol, expected, actual, round(100.0 * actual / expected, 2) AS coverage_pct, round(100.0 * actual / expected, 2) >= 99.9 AS meets_threshold FROM c""",
)
def coverage_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.coverage(hourly_bars(spark, sf_dir), HOURLY)


@query(
    "coverage_by_day",
    f"""WITH {HOURLY_BARS}, c AS (SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS actual FROM bars GROUP BY 1, 2)
    SELECT symbol, CAST(d AS VARCHAR) AS date, actual, 24 AS expected, round(100.0 * actual / 24, 2) AS coverage_pct,
    CASE WHEN round(100.0 * actual / 24, 2) < 95 THEN 'CRITICAL' WHEN round(100.0 * actual / 24, 2) < 99 THEN 'WARNING' ELSE 'PASS' END AS status FROM c""",
)
def coverage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = qc.daily_coverage(hourly_bars(spark, sf_dir), HOURLY)
    return df.withColumn("date", F.col("date").cast("string"))


@query(
    "consolidation_summary",
    f"""WITH {HOURLY_BARS} SELECT symbol, count(*) AS rows, min(ts) AS ts_min, max(ts) AS ts_max, count(DISTINCT CAST(ts AS DATE)) AS dates,
    5 AS feature_columns FROM bars GROUP BY symbol""",
)
def consolidation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.consolidation_summary(hourly_bars(spark, sf_dir), nz.OHLCV)


@query(
    "dataset_status",
    f"""WITH {HOURLY_BARS} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, 5 AS features, min(ts) AS ts_min, max(ts) AS ts_max FROM bars""",
)
def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.dataset_status(hourly_bars(spark, sf_dir), nz.OHLCV)


_GAPS = f"""WITH {HOURLY_BARS}, g AS (SELECT symbol, {lag('ts')} AS gap_start, ts AS gap_end FROM bars),
m AS (SELECT *, date_diff('second', gap_start, gap_end) / 60.0 AS gap_minutes FROM g)
SELECT symbol, gap_start, gap_end, gap_minutes, CAST(floor(gap_minutes / 60) AS BIGINT) - 1 AS missing_bars,
CASE WHEN gap_minutes >= 1440 THEN 'ALERT' WHEN gap_minutes > 60 THEN 'WARNING' ELSE 'INFO' END AS severity FROM m WHERE gap_minutes > 60"""


@query("gap_report", _GAPS)
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.gaps(hourly_bars(spark, sf_dir), HOURLY)


@query(
    "missing_slots_anti_join",
    f"""WITH {HOURLY_BARS}, b AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1),
    c AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b)
    SELECT symbol, ts FROM c WHERE NOT EXISTS (SELECT 1 FROM bars WHERE bars.symbol = c.symbol AND bars.ts = c.ts)""",
)
def missing_slots_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(qc.missing_slots(hourly_bars(spark, sf_dir), minutes=60))


@query(
    "price_jump_outliers",
    f"""WITH {HOURLY_BARS}, j AS (SELECT symbol, ts, close, close / nullif({lag('close')}, 0) - 1 AS change FROM bars)
    SELECT symbol, ts, close, {rnd('change')} AS change FROM j WHERE abs(change) > 0.5""",
)
def price_jump_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(qc.price_jumps(hourly_bars(spark, sf_dir), HOURLY), "change")


@query(
    "ohlcv_violations",
    f"""WITH {_RAW_SQL}, s AS (SELECT count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_price,
      count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (open > high OR open < low) AS open_out_of_range,
      count(*) FILTER (close > high OR close < low) AS close_out_of_range, count(*) FILTER (volume < 0) AS negative_volume FROM rawbars)
    SELECT "check", failed FROM s UNPIVOT (failed FOR "check" IN (non_positive_price, high_below_low, open_out_of_range, close_out_of_range, negative_volume))""",
)
def ohlcv_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_bars(spark, sf_dir).withColumn("ts", nz.to_minute("open_time"))
    return qc.validate_ohlcv(raw).select("check", "failed")


@query(
    "price_statistics",
    f"""WITH {TICK_BARS}, u AS (SELECT "column", value FROM raw UNPIVOT (value FOR "column" IN (open, high, low, close, volume)))
    SELECT "column", min(value) AS min, max(value) AS max, {rnd('avg(value)')} AS mean FROM u GROUP BY 1""",
)
def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(qc.price_statistics(tick_bars(spark, sf_dir)), "mean")


@query(
    "validate_structure",
    """SELECT 'duplicate_rows' AS "check", 'warning' AS level, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
         (SELECT count(*) AS n FROM events GROUP BY event_type, user_id)) AS failed
       UNION ALL SELECT 'not_empty', 'error', 0 UNION ALL SELECT 'min_rows', 'error', 0
       UNION ALL SELECT 'required_columns', 'error', 1 UNION ALL SELECT 'column_types', 'error', 1
       UNION ALL SELECT 'null_event_type', 'warning', count(*) FILTER (event_type IS NULL) FROM events
       UNION ALL SELECT 'null_user_id', 'warning', count(*) FILTER (user_id IS NULL) FROM events""",
)
def validate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "user_id")
    results = qc.validate_frame(df, required=["event_type", "price"], dtypes={"user_id": "string"})
    return results.select("check", "level", "failed")


@query(
    "validate_timestamps",
    """WITH o AS (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
       SELECT 'timestamp_type' AS "check", 0 AS failed UNION ALL SELECT 'null_timestamps', 0
       UNION ALL SELECT 'future_timestamps', count(*) FILTER (ts > TIMESTAMP '2024-01-29') FROM events
       UNION ALL SELECT 'duplicate_timestamps', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY user_id, ts)
       UNION ALL SELECT 'monotonic_timestamps', count(*) FILTER (ts < before) FROM o""",
)
def validate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    limit = F.lit(NOW).cast("timestamp_ntz")
    return qc.validate_timestamps(df, limit, key="user_id", arrival="event_id").select("check", "failed")


@query(
    "validation_roll_up",
    f"""WITH {_RAW_SQL}, s AS (SELECT count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS a,
      count(*) FILTER (high < low) AS b, count(*) FILTER (open > high OR open < low) AS c,
      count(*) FILTER (close > high OR close < low) AS d, count(*) FILTER (volume < 0) AS e FROM rawbars),
    p AS (SELECT (a = 0)::INT + (b = 0)::INT + (c = 0)::INT + (d = 0)::INT + (e = 0)::INT AS n, * FROM s)
    SELECT CAST(5 AS BIGINT) AS total_checks, CAST(n AS BIGINT) AS passed_checks, round(100.0 * n / 5, 2) AS success_rate,
    array_to_string(list_sort(list_filter([CASE WHEN a > 0 THEN a || ' non positive price' END, CASE WHEN b > 0 THEN b || ' high below low' END,
      CASE WHEN c > 0 THEN c || ' open out of range' END, CASE WHEN d > 0 THEN d || ' close out of range' END,
      CASE WHEN e > 0 THEN e || ' negative volume' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM p""",
)
def validation_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_bars(spark, sf_dir).withColumn("ts", nz.to_minute("open_time"))
    return qc.roll_up(qc.validate_ohlcv(raw)).select(
        "total_checks", "passed_checks", "success_rate", F.array_join("errors", "; ").alias("errors")
    )


@query(
    "partition_validity",
    f"""WITH {_RAW_SQL}, r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS part, * FROM rawbars),
    d AS (SELECT part, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT part, symbol, ts, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1),
    s AS (SELECT part, count(*) AS rows, count(*) FILTER (close IS NULL) AS null_rows,
      count(*) FILTER (coalesce(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false) OR coalesce(high < low, false)
        OR coalesce(open > high OR open < low, false) OR coalesce(close > high OR close < low, false) OR coalesce(volume < 0, false)) AS bad_ohlcv
      FROM r GROUP BY 1)
    SELECT part, rows, null_rows, bad_ohlcv, duplicates, CASE WHEN null_rows = 0 AND bad_ohlcv = 0 THEN 'valid' ELSE 'invalid' END AS status
    FROM s JOIN d USING (part)""",
)
def partition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_bars(spark, sf_dir).withColumn("ts", nz.to_minute("open_time"))
    df = raw.withColumn("part", F.to_date("ts").cast("string"))
    return qc.partition_validity(df, "part").select(
        "part", "rows", "null_rows", "bad_ohlcv", "duplicates", "status"
    )


# Bars of two deliveries: one in nine comes twice, one in thirteen without a symbol, a few out of order or after the end.
_DELIVERED = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS part, CASE WHEN event_id % 13 <> 0 THEN event_type END AS symbol,
  CASE WHEN event_id % 997 = 0 THEN ts + INTERVAL 400 DAYS WHEN event_id % 1009 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END AS ts,
  value AS open, value AS high, value AS low, value AS close, CASE WHEN event_id % 1511 = 0 THEN -1.0 ELSE 1.0 END AS volume, event_id * 2 + copy AS arrival,
  concat('load-', event_id % 3) AS load_id, CASE WHEN event_id % 5 <> 0 THEN concat('s', event_id % 2) END AS source
  FROM events, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 9 = 0"""


def delivered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("copy", F.explode(F.when(F.col("event_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    n, ts, price = F.col("event_id"), F.col("ts"), F.col("value")
    moved = F.when(n % 997 == 0, ts + F.expr("INTERVAL 400 DAYS")).when(n % 1009 == 0, ts - F.expr("INTERVAL 2 HOURS")).otherwise(ts)
    return events.select(
        F.to_date("ts").cast("string").alias("part"), F.when(n % 13 != 0, F.col("event_type")).alias("symbol"), moved.alias("ts"),
        *(price.alias(c) for c in ("open", "high", "low", "close")), F.when(n % 1511 == 0, -1.0).otherwise(1.0).alias("volume"),
        (n * 2 + F.col("copy")).alias("arrival"), F.concat(F.lit("load-"), n % 3).alias("load_id"), F.when(n % 5 != 0, F.concat(F.lit("s"), n % 2)).alias("source"),
    )


@query(
    "partition_validity_full",
    f"""WITH r AS ({_DELIVERED}),
    d AS (SELECT part, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT part, symbol, ts, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1),
    o AS (SELECT part, count(*) FILTER (ts < before) AS disorder FROM (SELECT part, ts, lag(ts) OVER (PARTITION BY part, symbol ORDER BY arrival) AS before FROM r) GROUP BY 1),
    s AS (SELECT part, count(*) AS rows, count(*) FILTER (volume < 0) AS bad_ohlcv, count(*) FILTER (ts > (SELECT max(ts) FROM events)) AS future FROM r GROUP BY 1)
    SELECT part, rows, bad_ohlcv, duplicates, future, disorder, duplicates = 0 AND future = 0 AND disorder = 0 AS timestamps_ok,
      CASE WHEN bad_ohlcv = 0 AND duplicates = 0 AND future = 0 AND disorder = 0 THEN 'valid' ELSE 'invalid' END AS status
    FROM s JOIN d USING (part) JOIN o USING (part)""",
)
def partition_validity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each date from repetitions, future and order as well, rows without a symbol included."""
    last = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    out = qc.partition_validity(delivered_bars(spark, sf_dir), "part", now=F.lit(last), arrival="arrival", unique=True)
    return out.select("part", "rows", "bad_ohlcv", "duplicates", "future", "disorder", "timestamps_ok", "status")


@query(
    "quality_report_nulls",
    f"""WITH r AS ({_DELIVERED}), d AS (SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicate_ts FROM (SELECT symbol, ts, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT r.symbol, count(*) AS rows, min(ts) AS ts_min, max(ts) AS ts_max, count(*) FILTER (volume < 0) AS n_negative_volume,
      count(DISTINCT load_id) AS load_ids, any_value(duplicate_ts) AS duplicate_ts FROM r JOIN d ON r.symbol IS NOT DISTINCT FROM d.symbol GROUP BY 1""",
)
def quality_report_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a symbol are part of the report."""
    out = qc.quality_report(delivered_bars(spark, sf_dir).drop("source"))
    return out.select("symbol", "rows", "ts_min", "ts_max", "n_negative_volume", "load_ids", "duplicate_ts")


@query(
    "duplicate_rows",
    f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
      SELECT part, symbol, ts, open, volume, load_id, source, count(*) AS n FROM ({_DELIVERED}) GROUP BY ALL)""",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.duplicate_count(delivered_bars(spark, sf_dir).drop("arrival"))


_KLINE = """SELECT event_type AS symbol, epoch_us(ts) // 1000 AS open_time, value AS open, CASE WHEN user_id % 10 = 0 THEN NULL ELSE round(value * 2, 2) END AS high,
  date_trunc('millisecond', ts) AS ts FROM events"""


@query("klines_from_json", _KLINE)
def klines_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kline arrays rendered from ticks, parsed back with bad numbers coerced to NULL."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    price = F.col("value").cast("string")
    high = F.when(F.col("user_id") % 10 == 0, "n/a").otherwise(F.round(F.col("value") * 2, 2).cast("string"))
    fields = F.array(ms, price, high, price, price, F.lit("1"), ms, F.lit("0"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0"))
    texts = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.to_json(F.array(fields)).alias("value")
    )
    return ntz(klines_from_text(texts)).select("symbol", "open_time", "open", "high", "ts")


@query(
    "order_book_top",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount > 0 THEN l_extendedprice * (1 - l_discount) END, 4) AS best_bid,
    round(CASE WHEN l_tax > 0 THEN l_extendedprice * (1 + l_tax) END, 4) AS best_ask,
    round(CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_extendedprice * (1 + l_tax) - l_extendedprice * (1 - l_discount) END, 4) AS spread FROM lineitem""",
)
def order_book_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda price: F.array(F.struct(price.alias("price"), F.col("l_quantity").alias("qty")))
    bid, ask = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax"))
    books = table(spark, sf_dir, "lineitem").withColumns(
        {
            "bids": F.when(F.col("l_discount") > 0, level(bid)).otherwise(F.slice(level(bid), 1, 0)),
            "asks": F.when(F.col("l_tax") > 0, level(ask)).otherwise(F.slice(level(ask), 1, 0)),
        }
    )
    top = nz.order_book_top(books)
    return top.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *(F.round(c, 4).alias(c) for c in ("best_bid", "best_ask", "spread")),
    )


# --- feature statistics --------------------------------------------------------------------------

STAT_COLUMNS = ["ret_1m", "hl_range", "ma_20", "rsi_14", "volatility_20", "volume_ma_20"]
_FAMILIES = ["price_returns", "trend_momentum", "volatility_risk", "volume_liquidity"]
_CFG = FeatureConfig()
_FEATS = f"""feats AS (SELECT symbol, ts, ret_1m, hl_range, {full('avg', 'close', 20)} AS ma_20,
  CASE WHEN ({full('avg', 'loss', 14)}) = 0 AND ({full('avg', 'gain', 14)}) > 0 THEN 100.0
    ELSE 100 - 100 / (1 + ({full('avg', 'gain', 14)}) / nullif({full('avg', 'loss', 14)}, 0)) END AS rsi_14,
  {full('stddev_samp', 'ret_1m', 20)} AS volatility_20, {full('avg', 'volume', 20)} AS volume_ma_20
  FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret_1m, (high - low) / nullif(close, 0) AS hl_range,
    coalesce(greatest(close - {lag('close')}, 0), 0) AS gain, coalesce(greatest({lag('close')} - close, 0), 0) AS loss FROM raw))"""
_LONG = f"""WITH {TICK_BARS}, {_FEATS}, cells AS (SELECT feature, value FROM feats UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(STAT_COLUMNS)})))"""


def stat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_features(tick_bars(spark, sf_dir), _CFG, _FAMILIES).select("symbol", "ts", *STAT_COLUMNS)


@query(
    "describe_features",
    f"""{_LONG} SELECT feature, count(value) AS count, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std, {rnd('min(value)')} AS min,
    {rnd('quantile_cont(value, 0.25)')} AS p25, {rnd('quantile_cont(value, 0.5)')} AS p50, {rnd('quantile_cont(value, 0.75)')} AS p75,
    {rnd('max(value)')} AS max FROM cells GROUP BY 1""",
)
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.describe(stat_features(spark, sf_dir), STAT_COLUMNS), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "feature_ranges",
    f"""{_LONG} SELECT feature, {rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('avg(value)')} AS mean,
    {rnd('stddev_samp(value)')} AS std, count(*) FILTER (value IS NULL) AS nan_count FROM cells GROUP BY 1""",
)
def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.feature_ranges(stat_features(spark, sf_dir), STAT_COLUMNS), "min", "max", "mean", "std")


@query(
    "nan_inf_counts",
    f"""{_LONG} SELECT feature, count(*) AS rows, count(*) FILTER (value IS NULL) AS nan_count, CAST(0 AS BIGINT) AS inf_count,
    round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS nan_pct,
    CASE WHEN count(*) FILTER (value IS NULL) > 0 THEN 'warnings' ELSE 'valid' END AS status FROM cells GROUP BY 1""",
)
def nan_inf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.missing_counts(stat_features(spark, sf_dir), STAT_COLUMNS)


@query(
    "extreme_counts",
    f"""{_LONG}, q AS (SELECT feature, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM cells GROUP BY 1)
    SELECT feature, count(*) FILTER (value < a OR value > b) AS extreme_count FROM cells JOIN q USING (feature) GROUP BY 1""",
)
def extreme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.extreme_counts(stat_features(spark, sf_dir), STAT_COLUMNS)


@query(
    "zscore_outliers",
    f"""{_LONG}, m AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM cells GROUP BY 1)
    SELECT feature, count(*) FILTER (s > 0 AND abs(value - m) / s > 6) AS outliers FROM cells JOIN m USING (feature) GROUP BY 1""",
)
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.zscore_outliers(stat_features(spark, sf_dir), STAT_COLUMNS)


_METRICS = f"""SELECT feature, {rnd('count(value) / count(*)')} AS non_na_pct, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std,
    {rnd('quantile_cont(value, 0.01)')} AS p1, {rnd('quantile_cont(value, 0.5)')} AS p50, {rnd('quantile_cont(value, 0.99)')} AS p99,
    CASE WHEN count(value) / count(*) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status,
    {rnd('greatest(0.0, count(value) / count(*) / 0.95)')} AS score FROM cells GROUP BY 1"""


@query("quality_metrics", f"{_LONG} {_METRICS}")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fq.quality_metrics(stat_features(spark, sf_dir), STAT_COLUMNS)
    return r6(df, "non_na_pct", "mean", "std", "p1", "p50", "p99", "score").drop("min", "max")


@query(
    "quality_gate",
    f"""{_LONG}, m AS ({_METRICS}) SELECT (SELECT count(*) FROM raw) AS rows, 7 AS expected_features, 1 AS missing_features,
    count(*) FILTER (status = 'FAIL') AS incomplete,
    (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, ts)) AS duplicates, 'FAIL' AS verdict FROM m""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.feature_set_gate(stat_features(spark, sf_dir), [*STAT_COLUMNS, "not_computed"])


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {rnd(f'corr({a}, {b})')} AS correlation FROM feats"
    for i, a in enumerate(STAT_COLUMNS)
    for b in STAT_COLUMNS[i + 1 :]
)


@query("corr_pairs", f"WITH {TICK_BARS}, {_FEATS} {_PAIRS}")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.correlation_pairs(stat_features(spark, sf_dir), STAT_COLUMNS), "correlation")


@query(
    "high_correlations",
    f"WITH {TICK_BARS}, {_FEATS}, p AS ({_PAIRS}) SELECT feature_a, feature_b, correlation FROM p WHERE abs(correlation) > 0.2",
)
def high_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = r6(fq.correlation_pairs(stat_features(spark, sf_dir), STAT_COLUMNS), "correlation")
    return fq.high_correlations(pairs, 0.2).select("feature_a", "feature_b", "correlation")


@query(
    "variance_topk",
    f"{_LONG} SELECT feature, {rnd('var_samp(value)')} AS variance FROM cells GROUP BY 1 ORDER BY var_samp(value) DESC LIMIT 3",
)
def variance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fq.variance_ranking(stat_features(spark, sf_dir), STAT_COLUMNS, 3), "variance")


@query(
    "analysis_summary",
    f"""{_LONG}, p AS ({_PAIRS}) SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(DISTINCT symbol) FROM raw) AS symbols,
    count(*) FILTER (value IS NULL) AS missing_cells, 6 AS features, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS missing_pct,
    (SELECT count(*) FROM p WHERE abs(correlation) > 0.8) AS high_correlation_pairs FROM cells""",
)
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stat_features(spark, sf_dir)
    return fq.analysis_summary(feats, STAT_COLUMNS, fq.correlation_pairs(feats, STAT_COLUMNS))


_RANGES = [("rsi_14", 20.0, 80.0), ("ret_1m", -0.99, None)]


@query(
    "anomaly_report",
    f"""WITH {TICK_BARS}, {_FEATS} SELECT symbol, ts, 'rsi_14' AS feature, {rnd('rsi_14')} AS value FROM feats WHERE rsi_14 < 20 OR rsi_14 > 80
    UNION ALL SELECT symbol, ts, 'ret_1m', {rnd('ret_1m')} FROM feats WHERE ret_1m < -0.99""",
)
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(_RANGES, "feature string, expected_low double, expected_high double")
    found = fq.anomalies(stat_features(spark, sf_dir), STAT_COLUMNS, ranges)
    return r6(found.select("symbol", "ts", "feature", "value"), "value")


_META = [
    ("ret_1m", "price_returns"), ("hl_range", "price_returns"), ("ma_20", "trend_momentum"),
    ("rsi_14", "trend_momentum"), ("kyle_lambda", "microstructure"),
]


@query(
    "metadata_quality",
    f"""{_LONG}, m AS ({_METRICS}), meta(name, family) AS (VALUES {', '.join(str(x) for x in _META)})
    SELECT name, family, coalesce(status, 'UNKNOWN') AS status, non_na_pct FROM meta LEFT JOIN m ON name = feature""",
)
def metadata_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame(_META, "name string, family string")
    metrics = fq.quality_metrics(stat_features(spark, sf_dir), STAT_COLUMNS)
    return r6(fq.with_quality(meta, metrics), "non_na_pct").select("name", "family", "status", "non_na_pct")
