"""Queries whose state outlives a batch: look-back of streams, feature tables updated by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.features import _HIGH_VOL, _WINSOR, CFG, FLAGS, FRAME_PARTS, shaped
from tickloom.catalog.quality import r6
from tickloom.catalog.registry import REGISTRY, query
from tickloom.catalog.sqltext import TICK_BARS, rnd
from tickloom.catalog.statistics import COLUMNS as FEATURES
from tickloom.catalog.statistics import all_features
from tickloom.operators import feature_qc as fq
from tickloom.operators.feature_state import dated_states, merged, write_states
from tickloom.operators.features import compute_features
from tickloom.session import durable, work_folder
from tickloom.sources.feature_table import FeatureTable
from tickloom.sources.tables import tick_bars
from tickloom.streaming import batch_replay, jobs
from tickloom.streaming.lookback import STORE
from tickloom.streaming.sessions import stream_sessions

FAMILIES = ("price_returns", "trend_momentum", "mean_reversion", "volatility_risk", "volume_liquidity")
# Rolling features of all of them, over one bar up to 720.
COLUMNS = (
    "ret_1m", "ret_15m", "hl_range", "ma_20", "ma_100", "momentum_10", "trend_slope_720", "breakout_20", "rsi_14", "bb_upper_20",
    "stoch_k_14", "williams_r_14", "atr_14", "volatility_20", "volume_ma_20", "volume_spike_20",
)


def frame_sql(columns: Sequence[str]) -> str:
    """One row per tick bar with these features."""
    tables, picked = [], []
    high = {f"high_volatility_{n}": f"high_volatility_{n}" for n in CFG.volatility}
    for columns_, base in [*FRAME_PARTS, (high, _HIGH_VOL.replace(f"WITH {TICK_BARS}, ", "WITH "))]:
        own = [c for c in columns_ if c in columns]
        if own:
            tables.append(f"p{len(tables)} AS (SELECT symbol, ts, {', '.join(f'{columns_[c]} AS {c}' for c in own)} FROM ({base}))")
            picked += own
    joined = " ".join(f"{'FROM' if i == 0 else 'JOIN'} p{i}{'' if i == 0 else ' USING (symbol, ts)'}" for i in range(len(tables)))
    cells = ", ".join(c if c.startswith(FLAGS) else f"{rnd(c)} AS {c}" for c in picked)
    return f"WITH {TICK_BARS}, {', '.join(tables)} SELECT symbol, ts, {cells} {joined}"


@query("stream_rolling_features", frame_sql(COLUMNS))
def stream_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars delivered in three turns, some a turn late: features from the look-back each series keeps as state."""
    out = batch_replay.run_lookback(spark, tick_bars(spark, sf_dir), 3, 6, FAMILIES, CFG, COLUMNS)
    return shaped(out, list(COLUMNS)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _in_two_steps(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    """A feature table of the first two thirds of the dates, brought up to date with the others."""
    folder = work_folder(spark, "feature-table")
    bars = tick_bars(spark, sf_dir).withColumns({"ts": F.col("ts").cast("timestamp"), "date": F.to_date("ts")})
    days = bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    table = FeatureTable(f"{folder}/table", **settings)
    if days["a"] is None:
        return compute_features(bars, CFG, table.families)
    cut = days["a"] + (days["b"] - days["a"]) * 2 / 3
    for part, since in ((bars.where(F.col("date") < F.lit(cut)), None), (bars.where(F.col("date") >= F.lit(cut)), cut)):
        part.repartitionByRange("date", "symbol", "ts").write.mode("append").partitionBy("date").parquet(f"{folder}/bars")
        table.update(spark, f"{folder}/bars", since)
    return table.read(spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# All but a mean weighted by whole numbers, which often is half a unit of the last place, and engines round that either way.
EVERY = sorted({c for columns, _ in FRAME_PARTS for c in columns if c != "volume_weighted_price"} | {f"high_volatility_{n}" for n in CFG.volatility})


@query("incremental_features", frame_sql(EVERY))
def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of a table updated by date, the flags over the whole history included."""
    return shaped(_in_two_steps(spark, sf_dir), EVERY)


@query("incremental_winsorize", _WINSOR)
def incremental_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _in_two_steps(spark, sf_dir, families=("price_returns",), winsorized=("ret_1m", "hl_range"))
    return shaped(out, ["ret_1m", "hl_range"])


def _states_by_date(spark: SparkSession, sf_dir: str, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """All features, and their states: stored for each date, the last one added by itself, merged on read."""
    folder = work_folder(spark, "states")
    frame = stored_frame(spark, sf_dir, folder)
    last = frame.agg(F.max("date")).first()[0]
    for part in (frame.where(F.col("date") < F.lit(last)), frame.where(F.col("date") == F.lit(last))):
        write_states(dated_states(part, FEATURES, pairs=pairs), f"{folder}/states")
    return frame, durable(merged(spark.read.parquet(f"{folder}/states").drop("date")))


def stored_frame(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    frame = all_features(spark, sf_dir).withColumn("date", F.to_date("ts"))
    frame.repartitionByRange("date", "symbol", "ts").write.partitionBy("date").parquet(f"{folder}/features")
    return spark.read.parquet(f"{folder}/features")


def _same_sql(name: str) -> str:
    return REGISTRY[name][1]


@query("describe_features_by_date", _same_sql("describe_features_all"))
def describe_features_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, states = _states_by_date(spark, sf_dir, pairs=False)
    return r6(fq.describe(frame, FEATURES, states), "mean", "std", "min", "p25", "p50", "p75", "max")


@query("corr_pairs_by_date", _same_sql("corr_pairs_all"))
def corr_pairs_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, states = _states_by_date(spark, sf_dir, pairs=True)
    return r6(fq.correlation_pairs(frame, FEATURES, states), "correlation")


@query("stream_sessions", _same_sql("session_gaps"))
def stream_sessions_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions out of the stream, from partial ones of short buckets joined in state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = batch_replay.run(spark, f"{sf_dir}/events.parquet", lambda events: stream_sessions(batch_replay.as_ticks(events)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(
    "stream_error_types",
    """WITH e AS (SELECT time_bucket(INTERVAL '20 minutes', ts) - INTERVAL '20 minutes' * k AS window_start, concat('E', user_id % 7) AS error_type
      FROM events, (VALUES (0), (1), (2)) v(k) WHERE event_type = 'error'),
    c AS (SELECT window_start, error_type, count(*) AS n FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, error_type) AS place FROM c)
    SELECT window_start, CAST(sum(n) AS BIGINT) AS errors, count(*) AS types, min(error_type) FILTER (place = 1) AS most_common,
      max(n) AS most_common_count, string_agg(concat(error_type, ':', n), ',' ORDER BY place) FILTER (place <= 3) AS top FROM r GROUP BY 1""",
)
def stream_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest error types per sliding window, out of the stream."""
    out = batch_replay.run(spark, f"{sf_dir}/events.parquet", lambda events: jobs.error_types(batch_replay.as_typed_errors(events)))
    shown = F.array_join(F.transform("top", lambda t: F.concat(t["error_type"], F.lit(":"), t["n"])), ",")
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "top": shown})
