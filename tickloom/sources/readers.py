"""Readers: bars, klines, features, trade logs, run metrics, audit events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.sources.zipped import zipped_lines

FORMATS = {"csv": "csv", "txt": "text", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def read_raw_bars(
    spark: SparkSession,
    raw_dir: str,
    symbols: Sequence[str] | None = None,
    timeframe: str = "1m",
    dump_layout: str = "kline",
) -> tuple[DataFrame, DataFrame]:
    """Raw CSV bars under ``raw_dir/SYMBOL/timeframe`` as (rows, malformed lines).

    ``symbol`` comes from the folder, ``load_id`` is the file stem and a file
    named ``*rest*`` is a REST top-up, any other a bulk dump. The file filter on
    ``_metadata`` prunes files before they are opened. Malformed lines end up in
    the second frame instead of failing the job.
    """
    chosen = "{" + ",".join(symbols) + "}" if symbols else "*"
    path = f"{raw_dir}/{chosen}/{timeframe}"
    from_rest = F.col("_metadata.file_name").contains("rest")
    dumps = _read_layout(spark, path, schema.RAW_LAYOUTS[dump_layout], ~from_rest, "binance:dump")
    tops = _read_layout(spark, path, schema.RAW_LAYOUTS["rest"], from_rest, "binance:rest")
    rows = dumps.unionByName(tops, allowMissingColumns=True)
    bad = F.col("_corrupt_record").isNotNull()
    good = rows.where(~bad).drop("_corrupt_record")
    return good, rows.where(bad).select("symbol", "source", "load_id", "_corrupt_record")


def _read_layout(
    spark: SparkSession, path: str, layout: str, files: Column, source: str
) -> DataFrame:
    columns = schema.parse(layout).names
    folders = F.split("file", "/")
    own = [c for c in columns if c not in ("symbol", "source", "load_id", "ts")]
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .text(path)
        .where(files)
        .select("value", F.col("_metadata.file_path").alias("file"))
        # Header lines repeat the first column's name.
        .where(~F.col("value").startswith(f"{columns[0]},") & (F.trim("value") != ""))
    )
    return _parsed(lines, layout, own, F.element_at(folders, -3), source)


def _parsed(lines: DataFrame, layout: str, own: Sequence[str], symbol: Column, source: str) -> DataFrame:
    """CSV lines (``value, file``) as typed columns; what does not parse is in ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_csv("value", f"{layout}, _corrupt_record string", options)
    return lines.withColumn("_row", parsed).select(
        *(F.col(f"_row.{c}").alias(c) for c in own),
        F.col("_row._corrupt_record").alias("_corrupt_record"),
        symbol.alias("symbol"),
        F.lit(source).alias("source"),
        file_stem(F.col("file")).alias("load_id"),
    )


def read_zipped_bars(
    spark: SparkSession,
    raw_dir: str,
    symbols: Sequence[str] | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    timeframe: str = "1m",
    dump_layout: str = "kline",
) -> tuple[DataFrame, DataFrame]:
    """Bulk dumps as they are stored, zipped: the rows of :func:`read_raw_bars` over the same files unpacked.

    ``symbols`` and the days (``yyyy-mm-dd``, of files named after one) decide which members are opened at all.
    """
    lines = zipped_lines(spark, raw_dir, timeframe)
    if symbols is not None:
        lines = lines.where(F.col("symbol").isin(list(symbols)))
    if first_day is not None:
        lines = lines.where(F.col("day") >= first_day)
    if last_day is not None:
        lines = lines.where(F.col("day") <= last_day)
    layout = schema.RAW_LAYOUTS[dump_layout]
    columns = schema.parse(layout).names
    own = [c for c in columns if c not in ("symbol", "source", "load_id", "ts")]
    lines = lines.where(~F.col("value").startswith(f"{columns[0]},") & (F.trim("value") != ""))
    rows = _parsed(lines, layout, own, F.col("symbol"), "binance:dump")
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).select("symbol", "source", "load_id", "_corrupt_record")


def klines_from_text(texts: DataFrame, value: str = "value") -> DataFrame:
    """JSON kline payloads (array of 12-element arrays) to one row per bar.

    Numbers that do not parse become NULL. Other columns are carried along.
    """
    rows = texts.withColumn("_k", F.explode(F.from_json(value, "array<array<string>>"))).drop(value)
    carried = [c for c in rows.columns if c != "_k"]
    kinds = {"open_time": "bigint", "close_time": "bigint", "n_trades": "bigint"}
    fields = [
        F.get("_k", F.lit(i)).try_cast(kinds.get(name, "double")).alias(name)
        for i, name in enumerate(schema.KLINE_FIELDS)
        if name != "ignore"
    ]
    return rows.select(*carried, *fields).withColumn("ts", F.timestamp_millis("open_time"))


def read_klines_json(spark: SparkSession, path: str) -> DataFrame:
    """Kline payload files; symbol and load_id come from the file name."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    stem = file_stem(F.col("file"))
    tagged = texts.select(
        "value",
        F.upper(F.regexp_extract(stem, r"^([A-Za-z0-9]+)", 1)).alias("symbol"),
        F.lit("binance:rest").alias("source"),
        stem.alias("load_id"),
    )
    return klines_from_text(tagged)


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Per-symbol or partitioned Parquet bars; symbol from the file name if absent."""
    bars = spark.read.option("mergeSchema", "false").parquet(path)
    if "symbol" not in bars.columns:
        stem = file_stem(F.col("_metadata.file_path"))
        bars = bars.select("*", F.upper(F.regexp_extract(stem, r"^([A-Za-z0-9]+)", 1)).alias("symbol"))
    if dict(bars.dtypes)["ts"] == "string":
        bars = bars.withColumn("ts", F.to_timestamp("ts"))
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    return bars


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table; adds the ``date`` column when the layout lacks it."""
    df = spark.read.parquet(path)
    return df if "date" in df.columns else df.withColumn("date", F.to_date("ts"))


def read_trades(spark: SparkSession, *paths: str) -> DataFrame:
    """Trade-leg CSV logs with or without the ``trade_pnl`` column, by name."""
    known = {f.name: f.dataType for f in schema.parse(schema.TRADE_LEG).fields}
    merged = None
    for path in paths:
        raw = spark.read.csv(path, header=True)
        part = raw.select(*(F.col(c).try_cast(known[c]).alias(c) for c in raw.columns if c in known))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged.select(*(c if c in merged.columns else F.lit(None).cast(t).alias(c) for c, t in known.items()))


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema.EQUITY_POINT)
    return spark.read.parquet(path)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per run."""
    return spark.read.schema(schema.RUN_METRICS).json(path, multiLine=True)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSONL audit events."""
    return spark.read.schema(schema.AUDIT_EVENT).json(path)


def load_table(spark: SparkSession, path: str, fmt: str = "auto", table_schema: T.StructType | None = None) -> DataFrame:
    """Read csv, txt, parquet, json or orc, choosing by extension when ``auto``."""
    kind = FORMATS[path.rstrip("/").rsplit(".", 1)[-1].lower()] if fmt == "auto" else FORMATS.get(fmt, fmt)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if table_schema is not None:
        reader = reader.schema(table_schema)
    return reader.load(path)
