"""Error health, analysis metrics, text, JSON and time-function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import ANALYSES, ERRORS, HOURLY_BARS, VOLUME, rnd
from tickloom.config import FeatureConfig
from tickloom.functions import timefn as tf
from tickloom.functions.numeric import rounded
from tickloom.functions.text import hash_embedding, token_estimate
from tickloom.operators import operations as ops
from tickloom.operators.features import compute_features
from tickloom.sources.tables import analyses, error_log, hourly_bars, table
from tickloom.streaming import batch_replay
from tickloom.streaming import jobs


def ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


_SCORE = """round(greatest(least(1.0 - CASE WHEN {rate} > 10 THEN 0.5 WHEN {rate} > 5 THEN 0.3 WHEN {rate} > 1 THEN 0.1 ELSE 0 END
  - CASE WHEN {critical} > 0 THEN 0.3 ELSE 0 END, 1.0), 0.0), 2)"""


def _windowed(width: str, hours: float) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', "timestamp") AS window_start, count(*) AS errors, count(*) FILTER (severity = 'critical') AS critical,
    {_SCORE.format(rate=f'(count(*) / {hours})', critical="count(*) FILTER (severity = 'critical')")} AS health FROM errors GROUP BY 1"""


@query("error_health", f"WITH {ERRORS} {_windowed('1 hour', 1.0)}")
def error_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.error_health_by_window(error_log(spark, sf_dir), "1 hour")
    return df.withColumn("window_start", ntz("window_start"))


@query(
    "error_health_sliding",
    f"""WITH {ERRORS}, w AS (SELECT time_bucket(INTERVAL '10 minutes', "timestamp") - INTERVAL '1 minute' * 10 * k AS window_start, severity
      FROM errors, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))
    SELECT window_start, count(*) AS errors, count(*) FILTER (severity = 'critical') AS critical,
    {_SCORE.format(rate='count(*)', critical="count(*) FILTER (severity = 'critical')")} AS health FROM w GROUP BY 1""",
)
def error_health_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.error_health_by_window(error_log(spark, sf_dir), "1 hour", "10 minutes")
    return df.withColumn("window_start", ntz("window_start"))


@query(
    "error_summary",
    f"""WITH {ERRORS}, r AS (SELECT * FROM errors WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'),
    t AS (SELECT error_type, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, error_type LIMIT 1)
    SELECT count(*) AS total_errors, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'error') AS n_error,
    count(*) FILTER (severity = 'warning') AS n_warning, (SELECT error_type FROM t) AS most_common, (SELECT n FROM t) AS most_common_count,
    {rnd('count(*) / 168.0')} AS rate_per_hour, {_SCORE.format(rate='(count(*) / 168.0)', critical="count(*) FILTER (severity = 'critical')")} AS health FROM r""",
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    df = ops.error_summary(error_log(spark, sf_dir), now, hours=168)
    return df.withColumn("rate_per_hour", rounded("rate_per_hour"))


@query(
    "analysis_metrics",
    f"""WITH {ANALYSES} SELECT count(*) AS analyses, {rnd('avg(latency_ms)')} AS latency_avg, min(latency_ms) AS latency_min, max(latency_ms) AS latency_max,
    {rnd('avg(confidence)')} AS confidence_avg, min(confidence) AS confidence_min, max(confidence) AS confidence_max, count(DISTINCT symbol) AS symbols FROM analyses""",
)
def analysis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.analysis_metrics(analyses(spark, sf_dir))
    return df.withColumns({c: rounded(c) for c in ("latency_avg", "confidence_avg")})


@query(
    "analysis_mix",
    f"""WITH {ANALYSES} SELECT coalesce(action_type, 'unknown') AS action_type, count(*) AS n, {rnd('100.0 * count(*) / (SELECT count(*) FROM analyses)')} AS pct FROM analyses GROUP BY 1""",
)
def analysis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.action_mix(analyses(spark, sf_dir)).withColumn("pct", rounded("pct"))


@query(
    "analysis_filters",
    f"WITH {ANALYSES} SELECT \"timestamp\", symbol, action_type, confidence FROM analyses WHERE symbol = 'SYM3' AND action_type = 'enter_long' AND confidence >= 0.6",
)
def analysis_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.filter_analyses(analyses(spark, sf_dir), "SYM3", "enter_long", 0.6)
    return df.select("timestamp", "symbol", F.col("action.type").alias("action_type"), F.col("action.confidence").alias("confidence"))


@query(
    "analysis_metrics_hourly",
    f"""WITH {ANALYSES} SELECT date_trunc('hour', "timestamp") AS window_start, count(*) AS analyses, {rnd('avg(latency_ms)')} AS latency_avg,
    {rnd('avg(confidence)')} AS confidence_avg, count(*) FILTER (action_type = 'hold') AS n_hold FROM analyses GROUP BY 1""",
)
def analysis_metrics_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = jobs.analysis_metrics_by_window(analyses(spark, sf_dir))
    return df.select(
        ntz("window_start").alias("window_start"), "analyses", rounded("latency_avg").alias("latency_avg"),
        rounded("confidence_avg").alias("confidence_avg"), "n_hold",
    )


@query(
    "token_estimate",
    r"""SELECT conv_id, turn, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3) AS BIGINT) AS tokens FROM conversations""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", token_estimate("text").alias("tokens"))


_HEX = "'0123456789abcdef'"
_BYTE = f"(strpos({_HEX}, substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos({_HEX}, substr(h, 2 * i + 2, 1)) - 1"


@query(
    "hash_embedding",
    f"""WITH m AS (SELECT conv_id, turn, md5(text) AS h FROM conversations), d AS (SELECT conv_id, turn, i + 16 * k AS dim, ({_BYTE}) / 255.0 AS value
      FROM m, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(8)) AS k))
    SELECT conv_id, turn, count(*) AS dims, {rnd('sum(value)')} AS total, {rnd('sum(value * dim)', 4)} AS weighted FROM d GROUP BY 1, 2""",
)
def embeddings_from_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", hash_embedding("text").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("e", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "conv_id", "turn", F.size("e").cast("long").alias("dims"), rounded(total).alias("total"), rounded(weighted, 4).alias("weighted")
    )


@query("json_props_parse", f"SELECT event_id, CAST({VOLUME} AS BIGINT) AS k FROM events")
def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: fenced, bare, nested, defaulted and broken ones."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"action": "enter_long", "confidence": 0.'), k, F.lit(', "reason": "momentum"}'))
    case = F.col("user_id") % 7
    text = (
        F.when(case == 0, F.concat(F.lit("Here is my view:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(case == 1, F.concat(F.lit("Result "), body, F.lit(" end")))
        .when(case == 2, F.concat(F.lit('{"result": '), body, F.lit("}")))
        .when(case == 3, F.concat(F.lit('```\n{"symbol": "ABC'), k, F.lit('"}\n```')))
        .when(case == 5, F.concat(F.lit("Cut off: "), F.regexp_replace(body, "}$", ",")))
        .when(case == 6, F.concat(F.lit("```json\n"), F.regexp_replace(body, "}$", ",}"), F.lit("\n```")))
        .otherwise(F.lit("no structured answer {broken"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), text.alias("response"))


@query(
    "response_parse",
    f"""WITH r AS (SELECT *, user_id % 7 AS c FROM events)
    SELECT event_id, CASE WHEN c = 3 THEN concat('ABC', CAST({VOLUME} AS BIGINT)) ELSE event_type END AS symbol,
    CASE WHEN c NOT IN (3, 4) THEN 'enter_long' ELSE 'hold' END AS action,
    CASE WHEN c NOT IN (3, 4) THEN CAST(concat('0.', CAST({VOLUME} AS BIGINT)) AS DOUBLE) WHEN c = 3 THEN 0.5 ELSE 0.0 END AS confidence,
    CASE WHEN c NOT IN (3, 4) THEN 'momentum' WHEN c = 3 THEN 'Analysis completed' ELSE 'JSON parsing failed' END AS reason,
    c = 4 AS parse_error FROM r""",
)
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.parse_responses(_responses(spark, sf_dir))
    return df.select("event_id", "symbol", "action", "confidence", "reason", "parse_error")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    doc = F.to_json(
        F.struct(
            F.when(k == 1, "1.0").otherwise("1.0.0").alias("version"),
            F.when(k == 2, "guess").otherwise("analyze").alias("intent"),
            F.when(k == 3, "bad symbol").otherwise("ABC").alias("symbol"),
            F.when(k != 4, "1h").alias("timeframe"),
            F.when(k == 5, "short").otherwise("a sufficiently long rationale text").alias("rationale"),
            F.struct(
                F.when(k == 6, "jump").otherwise("hold").alias("type"),
                F.when(k != 7, k / 50).alias("confidence"),
                F.when(k == 9, 1).alias("mood"),
                F.struct((k / 150).alias("stop_loss_pct"), F.lit("swing").alias("time_horizon")).alias("constraints"),
            ).alias("action"),
            F.when(k == 8, 1).alias("extra"),
        )
    )
    return table(spark, sf_dir, "events").select("event_id", doc.alias("value"))


@query(
    "contract_validation",
    f"""WITH d AS (SELECT event_id, {VOLUME} AS k FROM events) SELECT event_id, array_to_string(list_filter([
      CASE WHEN k = 4 THEN 'timeframe: required' END, CASE WHEN k = 1 THEN 'version: bad pattern' END, CASE WHEN k = 3 THEN 'symbol: bad pattern' END,
      CASE WHEN k = 2 THEN 'intent: not allowed' END, CASE WHEN k = 5 THEN 'rationale: bad length' END, CASE WHEN k = 7 THEN 'action.confidence: required' END,
      CASE WHEN k = 6 THEN 'action.type: not allowed' END, CASE WHEN k <> 7 AND k / 50 > 1 THEN 'action.confidence: out of range' END,
      CASE WHEN k / 150 > 0.5 THEN 'action.constraints.stop_loss_pct: out of range' END,
      CASE WHEN k = 8 THEN 'extra: unknown' END, CASE WHEN k = 9 THEN 'action.mood: unknown' END], lambda x: x IS NOT NULL), '; ') AS violations FROM d""",
)
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ops.parse_documents(_documents(spark, sf_dir))
    return docs.select("event_id", F.array_join(ops.contract_violations(value="value"), "; ").alias("violations"))


# --- time functions ---------------------------------------------------------------------------------

_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dd/MM/yyyy HH:mm:ss")


@query(
    "timestamp_parse",
    """SELECT event_id, CASE event_id % 8 WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN ts
      WHEN 6 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE WHEN 7 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""",
)
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight spellings of each event time: six formats, an offset form, garbage."""
    text = F.lit("not a time")
    kind = F.col("event_id") % 8
    text = F.when(kind == 6, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30"))).otherwise(text)
    for i, fmt in enumerate(_FORMATS):
        text = F.when(kind == i, F.date_format("ts", fmt)).otherwise(text)
    df = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return df.select("event_id", ntz(tf.parse_timestamp("text")).alias("parsed"))


@query(
    "epoch_parse",
    """SELECT event_id, make_timestamp(CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) // 1000000 * 1000000 END) AS parsed FROM events""",
)
def epoch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    number = F.when(F.col("event_id") % 2 == 0, F.unix_millis(ts)).otherwise(F.unix_seconds(ts))
    return table(spark, sf_dir, "events").select("event_id", ntz(tf.epoch_to_timestamp(number)).alias("parsed"))


@query(
    "timestamp_format",
    """SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN strftime(ts, '%f') <> '000000' THEN concat('.', strftime(ts, '%f')) ELSE '' END, '+00:00') AS iso,
    concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' UTC') AS human, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS short_new_york FROM events""",
)
def timestamp_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        tf.format_timestamp("ts").alias("iso"),
        tf.format_timestamp("ts", "human").alias("human"),
        tf.format_timestamp("ts", "short", "America/New_York").alias("short_new_york"),
    )


# January only, so New York is five hours behind UTC throughout.
_NY = "(ts - INTERVAL 5 HOUR)"
_WD = "(isodow({}) - 1)"


@query(
    "market_session_flag",
    f"""SELECT event_id, true AS crypto_open, isodow(ts) <= 5 AS forex_open,
    isodow(ts) <= 5 AND CAST({_NY} AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' AS stocks_open FROM events""",
)
def market_session_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        tf.market_open("ts").alias("crypto_open"),
        tf.market_open("ts", "forex").alias("forex_open"),
        tf.market_open("ts", "stocks").alias("stocks_open"),
    )


@query(
    "next_market_open",
    f"""WITH n AS (SELECT event_id, ts, {_NY} AS ny FROM events), d AS (SELECT *, CAST(ny AS DATE) + CASE isodow(ny) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS day FROM n),
    e AS (SELECT *, CASE WHEN CAST(ny AS TIME) >= TIME '09:30:00' THEN day + CASE WHEN isodow(day) = 5 THEN 3 ELSE 1 END ELSE day END AS od FROM d)
    SELECT event_id, ts AS crypto_next, CAST(od AS TIMESTAMP) + INTERVAL '14 hours 30 minutes' AS stocks_next FROM e""",
)
def next_market_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        ntz(tf.next_market_open("ts")).alias("crypto_next"),
        ntz(tf.next_market_open("ts", "stocks")).alias("stocks_next"),
    )


@query(
    "time_difference",
    f"""SELECT event_id, {rnd("abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 6e7", 9)} AS minutes, {rnd("abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 8.64e10", 12)} AS days FROM events""",
)
def time_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        rounded(tf.time_difference("ts", anchor), 9).alias("minutes"),
        rounded(tf.time_difference("ts", anchor, "days"), 12).alias("days"),
    )


@query(
    "time_round",
    """WITH m AS (SELECT event_id, epoch_us(ts) // 60000000 AS m FROM events)
    SELECT event_id, make_timestamp(CAST(round_even(m / 15, 0) AS BIGINT) * 15 * 60000000) AS nearest_15m,
    make_timestamp(CAST(round_even(m / 2, 0) AS BIGINT) * 2 * 60000000) AS nearest_2m FROM m""",
)
def time_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        ntz(tf.round_timestamp("ts", 15)).alias("nearest_15m"),
        ntz(tf.round_timestamp("ts", 2)).alias("nearest_2m"),
    )


@query(
    "time_range",
    """WITH r AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL '23 hours 45 minutes', INTERVAL 15 MINUTE)) AS ts FROM events),
    e AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, count(*) AS n FROM events GROUP BY 1)
    SELECT r.ts, coalesce(n, 0) AS n FROM r LEFT JOIN e ON r.ts = e.ts""",
)
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per calendar slot, empty slots included."""
    days = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).cast("string").alias("a"), F.to_date(F.max("ts")).cast("string").alias("b")).first()
    slots = tf.time_range(spark, days["a"], f"{days['b']} 23:45:00", 15)
    counts = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"].alias("ts")).agg(
        F.count("*").alias("n")
    )
    return slots.join(counts, "ts", "left").select(ntz("ts").alias("ts"), F.coalesce("n", F.lit(0)).alias("n"))


# --- streams -----------------------------------------------------------------------------------------

@query(
    "session_gaps",
    """WITH g AS (SELECT event_type AS symbol, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM g)
    SELECT symbol, min(ts) AS session_start, max(ts) + INTERVAL 60 MINUTE AS session_end, count(*) AS ticks FROM s GROUP BY symbol, sid""",
)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    df = jobs.stored_sessions(ticks)
    return df.withColumns({"session_start": ntz("session_start"), "session_end": ntz("session_end")})


@query("stream_bars", f"WITH {HOURLY_BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks streamed into hourly bars."""
    out = batch_replay.run(
        spark, f"{sf_dir}/events.parquet", lambda events: jobs.bars_from_ticks(batch_replay.as_ticks(events), "1 hour", "1 hour")
    )
    return out.select("symbol", ntz("ts").alias("ts"), "open", "high", "low", "close", F.col("ticks").cast("double").alias("volume"))


@query(
    "stream_error_health",
    f"WITH {ERRORS}, w AS ({_windowed('1 hour', 1.0)}) SELECT * FROM w",
)
def stream_error_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch_replay.run(spark, f"{sf_dir}/events.parquet", lambda events: jobs.error_health(batch_replay.as_errors(events)))
    return out.withColumn("window_start", ntz("window_start"))


@query(
    "stream_analysis_metrics",
    f"""WITH {ANALYSES} SELECT date_trunc('hour', "timestamp") AS window_start, count(*) AS analyses, {rnd('avg(latency_ms)')} AS latency_avg,
    count(*) FILTER (action_type = 'hold') AS n_hold FROM analyses GROUP BY 1""",
)
def stream_analysis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch_replay.run(
        spark,
        f"{sf_dir}/events.parquet",
        lambda events: jobs.analysis_metrics_by_window(batch_replay.as_analyses(events), late="1 hour"),
    )
    return out.select(ntz("window_start").alias("window_start"), "analyses", rounded("latency_avg").alias("latency_avg"), "n_hold")


@query(
    "stream_clean_bars",
    f"""WITH raw AS (SELECT event_type AS symbol, ts, value, {VOLUME} AS k FROM events)
    SELECT symbol, ts, value AS close FROM raw WHERE k <> 3 AND k <> 4""",
)
def stream_clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick bar sent twice, some broken: valid ones come out once."""
    def build(events: DataFrame) -> DataFrame:
        valid, _ = jobs.checked_bars(batch_replay.as_repeated_bars(events))
        return valid

    out = batch_replay.run(spark, f"{sf_dir}/events.parquet", build)
    return out.select("symbol", ntz("ts").alias("ts"), "close")


@query(
    "stream_features",
    f"""SELECT event_type AS symbol, ts, {rnd('CASE WHEN count(*) OVER w = 20 THEN avg(value) OVER w END')} AS ma_20 FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick bars arriving as a stream, their 20-bar mean kept current in a feature table."""
    cfg = FeatureConfig(ma=(20,), ema=(), regression=(), momentum=(), rsi=())

    def compute(bars: DataFrame) -> DataFrame:
        return compute_features(bars, cfg, ["trend_momentum"]).select("symbol", "ts", "date", "ma_20")

    out = batch_replay.run_features(
        spark, f"{sf_dir}/events.parquet", batch_replay.as_bars, compute, lookback_bars=20
    )
    return out.select("symbol", ntz("ts").alias("ts"), rounded("ma_20").alias("ma_20"))
