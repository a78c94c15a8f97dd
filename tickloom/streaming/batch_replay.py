"""Replay a stored table through a streaming query until it is exhausted."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import FeatureConfig
from tickloom.operators.features import compute_features
from tickloom.session import configure, durable, work_folder
from tickloom.streaming.jobs import features_per_batch
from tickloom.streaming.lookback import stream_features


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )


def as_errors(events: DataFrame) -> DataFrame:
    value = F.col("value")
    return events.where(F.col("event_type") == "error").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(value > 150, "critical").when(value > 60, "error").otherwise("warning").alias("severity"),
    )


def as_typed_errors(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "error").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("E"), F.col("user_id") % 7).alias("error_type")
    )


def as_analyses(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "hold").when(kind == "view", "enter_long").when(kind == "signup", "enter_short").when(kind == "purchase", "exit")
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.struct(
            action.alias("type"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence")
        ).alias("action"),
        F.round(F.col("value") * 10, 2).alias("latency_ms"),
    )


def as_bars(events: DataFrame) -> DataFrame:
    value = F.col("value")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        *(value.alias(c) for c in ("open", "high", "low", "close")),
        F.lit(1.0).alias("volume"),
    )


def as_repeated_bars(events: DataFrame) -> DataFrame:
    """Each tick as a bar, delivered twice; two payload values make it invalid."""
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        value.alias("open"),
        F.when(k == 3, value * 0.5).otherwise(value).alias("high"),
        value.alias("low"),
        F.when(k != 4, value).alias("close"),
        k.alias("volume"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    ).drop("delivery")


def _source(spark: SparkSession, path: str) -> DataFrame:
    """Streaming read of one Parquet file or a folder of them."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    location, name = path.rsplit("/", 1)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(location)
    return reader.parquet(path)


def _markers(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """A second source of the same shape, still empty: its one later row closes every window."""
    schema = events.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def _close(spark: SparkSession, path: str, folder: str) -> None:
    """Ten years after the last event nothing is open any more; the marker's own windows stay in state."""
    last = spark.read.parquet(path).agg(F.max("ts").alias("last")).where("last IS NOT NULL")
    shape = spark.read.schema(spark.read.parquet(path).schema).parquet(folder)
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in shape.schema}
    kind = shape.schema["ts"].dataType
    row = blank | {"ts": (F.col("last") + F.expr("INTERVAL 10 YEARS")).cast(kind).alias("ts"), "event_type": F.lit("error").alias("event_type")}
    last.select(*row.values()).write.mode("append").parquet(folder)


def run(
    spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], output: str | None = None
) -> DataFrame:
    """Stream ``path`` through ``build`` into a Parquet sink and read it back, all windows closed."""
    configure(spark)
    folder = output or work_folder(spark, "stream")
    markers = f"{folder}/markers"
    source = _source(spark, path)
    whole = source.unionByName(_markers(spark, markers, source))
    for turn in range(2):
        query = (
            build(whole)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{folder}/data")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if turn == 0:
            _close(spark, path, markers)
    return spark.read.parquet(f"{folder}/data")


def run_features(
    spark: SparkSession,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    compute: Callable[[DataFrame], DataFrame],
    lookback_bars: int,
) -> DataFrame:
    """Stream bars into a stored table and keep their features current; read the features."""
    configure(spark)
    folder = work_folder(spark, "stream")
    handle = features_per_batch(spark, f"{folder}/bars", f"{folder}/features", compute, lookback_bars)
    query = (
        build(_source(spark, path))
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/features")


def run_lookback(
    spark: SparkSession,
    bars: DataFrame,
    turns: int,
    late_hours: int,
    families: Sequence[str],
    cfg: FeatureConfig | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Bars arriving in ``turns`` deliveries through :func:`stream_features`; the features of all of them.

    Deliveries are equal spans of time; one bar in ten of the last ``late_hours`` of a span comes with the next
    one. A bar ten years later lets the watermark pass all others.
    """
    configure(spark)
    folder = work_folder(spark, "stream")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    edge = bars.agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.max("ts").alias("end")).first()
    if edge["first"] is None:
        empty = compute_features(bars, cfg, families)
        return empty.select("symbol", "ts", *columns) if columns else empty
    span = (edge["last"] - edge["first"]) // turns + 1
    turn = F.floor((micros - edge["first"]) / span)
    to_end = (turn + 1) * span - (micros - edge["first"])
    is_late = (to_end <= late_hours * 3_600_000_000) & (F.pmod(F.xxhash64("symbol", "ts"), F.lit(10)) == 0)
    dealt = bars.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("turn", turn + is_late.cast("int"))
    dealt = durable(dealt)
    dealt.drop("turn").limit(0).write.parquet(f"{folder}/bars")
    source = spark.readStream.schema(dealt.drop("turn").schema).parquet(f"{folder}/bars")
    for k in range(turns + 2):
        if k <= turns:
            arrived = dealt.where(F.col("turn") == k)
        else:
            arrived = dealt.where(F.unix_micros("ts") == edge["last"]).limit(1)
            arrived = arrived.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 10 YEARS"), "symbol": F.lit("~").cast(dealt.schema["symbol"].dataType)})
        arrived.drop("turn").write.mode("append").parquet(f"{folder}/bars")
        started = stream_features(spark, source, f"{folder}/features", f"{folder}/checkpoint", f"{late_hours} hours", cfg, families, columns=columns)
        started.awaitTermination()
    return spark.read.parquet(f"{folder}/features").drop("batch")
