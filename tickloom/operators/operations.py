"""Operational logs: errors, model analyses, responses, action documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions.numeric import clip, count_if
from tickloom.functions.text import response_json

# Fixed enumerations of the action contract.
INTENTS = ("analyze", "propose_trade", "explain", "regime_analysis", "risk_assessment")
TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h", "1d")
ACTION_TYPES = ("hold", "enter_long", "enter_short", "exit", "reduce_position", "increase_position")
HORIZONS = ("intraday", "swing", "position")
REGIMES = ("trending", "ranging", "volatile", "calm", "breakout", "consolidation")


def health_score(rate_per_hour: Column, critical: Column) -> Column:
    """1.0 less 0.5 / 0.3 / 0.1 above 10 / 5 / 1 errors per hour, less 0.3 if any is critical."""
    by_rate = (
        F.when(rate_per_hour > 10, 0.5).when(rate_per_hour > 5, 0.3).when(rate_per_hour > 1, 0.1).otherwise(0.0)
    )
    score = 1.0 - by_rate - F.when(critical > 0, 0.3).otherwise(0.0)
    return F.round(clip(score, F.lit(0.0), F.lit(1.0)), 2)


def error_summary(errors: DataFrame, now: datetime | Column, hours: int = 24) -> DataFrame:
    """Totals by severity and type over the look-back, rate, commonest type, health.

    Two levels: counts per (severity, type), then one row.
    """
    end = now if isinstance(now, Column) else F.lit(now)
    start = end - F.make_dt_interval(hours=F.lit(hours))
    recent = errors.where((F.col("timestamp") >= start) & (F.col("timestamp") <= end))
    cells = recent.groupBy("severity", "error_type").agg(F.count("*").alias("n"))
    types = cells.groupBy("error_type").agg(F.sum("n").alias("n")).agg(
        F.min_by("error_type", F.struct(-F.col("n"), F.col("error_type"))).alias("most_common"),
        F.max("n").alias("most_common_count"),
        F.lit(1).alias("_one"),
    )
    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_errors"),
        *(
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
            for s in ("critical", "error", "warning")
        ),
        F.lit(1).alias("_one"),
    )
    rate = F.col("total_errors") / F.lit(float(hours))
    return (
        totals.join(types, "_one")
        .drop("_one")
        .withColumns({"rate_per_hour": rate, "health": health_score(rate, F.col("n_critical"))})
    )


def error_health_by_window(errors: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Error counts and health per tumbling (or sliding) window; batch or stream."""
    window = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        errors.groupBy(window.alias("w"))
        .agg(F.count("*").alias("errors"), count_if(F.col("severity") == "critical").alias("critical"))
        .withColumn(
            "_hours", (F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))) / 3600
        )
        .select(
            F.col("w.start").alias("window_start"),
            "errors",
            "critical",
            health_score(F.col("errors") / F.col("_hours"), F.col("critical")).alias("health"),
        )
    )


def analysis_metrics(analyses: DataFrame) -> DataFrame:
    """Latency and confidence ranges, analyses and distinct symbols."""
    confidence = F.col("action.confidence")
    return analyses.agg(
        F.count("*").alias("analyses"),
        F.avg("latency_ms").alias("latency_avg"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        F.avg(confidence).alias("confidence_avg"),
        F.min(confidence).alias("confidence_min"),
        F.max(confidence).alias("confidence_max"),
        F.count_distinct("symbol").alias("symbols"),
    )


def action_mix(analyses: DataFrame) -> DataFrame:
    """Count and share of each action type; a missing type is 'unknown'."""
    counts = analyses.groupBy(F.coalesce("action.type", F.lit("unknown")).alias("action_type")).agg(
        F.count("*").alias("n")
    )
    total = counts.agg(F.sum("n").alias("total"), F.lit(1).alias("_one"))
    return (
        counts.withColumn("_one", F.lit(1))
        .join(total, "_one")
        .select("action_type", "n", (100 * F.col("n") / F.col("total")).alias("pct"))
    )


def filter_analyses(
    analyses: DataFrame,
    symbol: str | None = None,
    action_type: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    if symbol is not None:
        analyses = analyses.where(F.col("symbol") == symbol)
    if action_type is not None:
        analyses = analyses.where(F.col("action.type") == action_type)
    if min_confidence is not None:
        analyses = analyses.where(F.col("action.confidence") >= min_confidence)
    return analyses


def parse_responses(
    responses: DataFrame, text: str = "response", symbol: str = "symbol", timeframe: str = "1m"
) -> DataFrame:
    """Model responses to action columns; defaults fill gaps, failures are marked.

    The object may sit in a fenced block, bare in the text, or under ``result``.
    """
    payload = response_json(text)
    base = responses.withColumn("_json", payload)
    inner = F.coalesce(F.get_json_object("_json", "$.result"), F.col("_json"))
    base = base.withColumn("_json", inner)
    field = lambda name, default: F.coalesce(F.get_json_object("_json", f"$.{name}"), default)
    failed = F.col("_json").isNull()
    return base.withColumns(
        {
            "symbol": field("symbol", F.col(symbol)),
            "timeframe": field("timeframe", F.lit(timeframe)),
            "action": field("action", F.lit("hold")),
            "confidence": F.when(failed, F.lit(0.0)).otherwise(
                F.coalesce(F.get_json_object("_json", "$.confidence").try_cast("double"), F.lit(0.5))
            ),
            "reason": F.when(failed, "JSON parsing failed").otherwise(field("reason", F.lit("Analysis completed"))),
            "price_target": field("price_target", F.lit("N/A")),
            "stop_loss": field("stop_loss", F.lit("N/A")),
            "parse_error": failed,
        }
    ).drop("_json")


def parse_documents(texts: DataFrame, value: str = "value") -> DataFrame:
    """JSON action documents into typed nested columns."""
    return texts.withColumn("doc", F.from_json(value, schema.ACTION_DOCUMENT))


def unknown_fields(value: str = "value") -> Column:
    """Fields of the document, or of its action, that the contract does not know."""
    known = schema.parse(schema.ACTION_DOCUMENT)

    def extra(json: Column, names: list[str], prefix: str) -> Column:
        keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
        return F.transform(F.array_except(keys, F.array(*map(F.lit, names))), lambda k: F.concat(F.lit(prefix), k, F.lit(": unknown")))

    return F.concat(
        extra(F.col(value), known.names, ""),
        extra(F.get_json_object(value, "$.action"), known["action"].dataType.names, "action."),
    )


def contract_violations(doc: str = "doc", value: str | None = None) -> Column:
    """Names of the contract rules an action document breaks (empty when valid); ``value``, its text, shows unknown fields too."""
    c = lambda path: F.col(f"{doc}.{path}")
    absent = lambda path: F.when(c(path).isNull(), f"{path}: required")
    enum = lambda path, members: F.when(~c(path).isin(*members), f"{path}: not allowed")
    within = lambda path, low, high: F.when(~c(path).between(low, high), f"{path}: out of range")
    rules = [
        *(absent(p) for p in ("version", "intent", "symbol", "timeframe", "rationale", "action")),
        F.when(~c("version").rlike(r"^\d+\.\d+\.\d+$"), "version: bad pattern"),
        F.when(~c("symbol").rlike(r"^[A-Z0-9]+$"), "symbol: bad pattern"),
        enum("intent", INTENTS),
        enum("timeframe", TIMEFRAMES),
        F.when(~F.length(c("rationale")).between(20, 500), "rationale: bad length"),
        F.when(c("action").isNotNull() & c("action.type").isNull(), "action.type: required"),
        F.when(c("action").isNotNull() & c("action.confidence").isNull(), "action.confidence: required"),
        enum("action.type", ACTION_TYPES),
        within("action.confidence", 0.0, 1.0),
        within("action.constraints.max_position_size", 0.0, 1.0),
        within("action.constraints.stop_loss_pct", 0.0, 0.5),
        within("action.constraints.take_profit_pct", 0.0, 2.0),
        enum("action.constraints.time_horizon", HORIZONS),
        enum("action.regime_context.regime_type", REGIMES),
        within("action.regime_context.regime_confidence", 0.0, 1.0),
    ]
    broken = F.array_compact(F.array(*rules))
    return broken if value is None else F.concat(broken, unknown_fields(value))
