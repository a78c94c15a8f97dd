"""Feature queries over tick bars (long series) and hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.sqltext import HOURLY_BARS, TICK_BARS, frame, full, lag, rnd
from tickloom.config import FeatureConfig
from tickloom.functions.numeric import rounded
from tickloom.operators.feature_qc import long_form
from tickloom.operators.cross_asset import align_to_driver, driver_features, pair_features
from tickloom.operators.features import (
    compute_features,
    feature_names,
    volatility_percentile,
    winsorize,
)
from tickloom.sources.tables import hourly_bars, tick_bars

CFG = FeatureConfig()
ANNUAL = math.sqrt(1440 * 365)
FLAGS = ("breakout", "volume_spike", "trend_up", "high_liquidity", "high_volatility")


def shaped(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.select(
        "symbol",
        "ts",
        *(F.col(c) if c.startswith(FLAGS) else rounded(c, places).alias(c) for c in columns),
    )


# (columns, base SQL) of the default families, for the digest of the whole frame.
FRAME_PARTS: list[tuple[dict[str, str], str]] = []
# Family of each of their columns (feature_names() needs a running session).
FAMILY_OF = {f"high_volatility_{n}": "regime" for n in CFG.volatility}


def feature_query(
    name: str,
    families: list[str],
    columns: dict[str, str],
    base: str = "SELECT * FROM raw",
    cfg: FeatureConfig = CFG,
    places: int = 6,
) -> None:
    """Register ``columns`` (name -> SQL over ``x``) of ``families`` on the tick bars."""
    picked = ", ".join(
        f"{sql if c.startswith(FLAGS) else rnd(sql, places)} AS {c}" for c, sql in columns.items()
    )
    sql = f"WITH {TICK_BARS}, x AS ({base}) SELECT symbol, ts, {picked} FROM x"
    if "extras" not in families and cfg is CFG:
        FRAME_PARTS.append((columns, base))
        FAMILY_OF.update(dict.fromkeys(columns, families[-1]))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compute_features(tick_bars(spark, sf_dir), cfg, families)
        return shaped(df, list(columns), places)

    query(name, sql)(run)


RETS = f"SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM raw"

feature_query(
    "ret_multi",
    ["price_returns"],
    {f"ret_{k}m": f"close / nullif({lag('close', k)}, 0) - 1" for k in (1, 5, 15)},
)
feature_query("log_ret", ["price_returns"], {"log_ret_1m": f"ln(close / nullif({lag('close')}, 0))"})
feature_query(
    "intrabar",
    ["price_returns"],
    {
        "close_to_open": "(close - open) / nullif(open, 0)",
        "hl_range": "(high - low) / nullif(close, 0)",
        "oc_abs": "abs(open - close) / nullif(close, 0)",
    },
)
feature_query("ma_set", ["trend_momentum"], {f"ma_{n}": full("avg", "close", n) for n in (20, 50, 100)})
feature_query("momentum", ["trend_momentum"], {f"momentum_{k}": f"close - {lag('close', k)}" for k in (10, 20)})
feature_query(
    "trend_slope",
    ["trend_momentum"],
    {f"trend_slope_{n}": full("regr_slope({}, rn)", "close", n) for n in (20, 240, 720)},
    base="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM raw",
)
_BEFORE = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
feature_query(
    "breakout",
    ["trend_momentum"],
    {
        "breakout_20": f"CAST(coalesce(count(close) OVER {_BEFORE} = 20 AND close > max(close) OVER {_BEFORE}, false) AS INTEGER)"
    },
)


def _ema_sql(n: int) -> str:
    """Bounded weighted sum over the last 16 * n bars (dropped weight below 1e-13)."""
    length, decay = 16 * n, 1 - 2 / (n + 1)
    items = f"list(close) OVER {frame(length)}"
    return (
        f"CASE WHEN count(close) OVER {frame(n)} = {n} THEN "
        f"list_sum(list_transform({items}, lambda v, i: v * pow({decay!r}, len({items}) - i))) / "
        f"((1 - pow({decay!r}, count(close) OVER {frame(length)})) / {1 - decay!r}) END"
    )


feature_query("ema", ["trend_momentum"], {f"ema_{n}": _ema_sql(n) for n in (20, 50)})

_GAIN_LOSS = f"""SELECT *, coalesce(greatest(d, 0), 0) AS gain, coalesce(greatest(-d, 0), 0) AS loss
FROM (SELECT *, close - {lag('close')} AS d FROM raw)"""


def _rsi_sql(n: int) -> str:
    gain, loss = full("avg", "gain", n), full("avg", "loss", n)
    return (
        f"CASE WHEN ({loss}) = 0 AND ({gain}) > 0 THEN 100.0 "
        f"ELSE 100 - 100 / (1 + ({gain}) / nullif({loss}, 0)) END"
    )


feature_query("rsi", ["trend_momentum"], {"rsi_14": _rsi_sql(14)}, base=_GAIN_LOSS)

_MID, _SD = full("avg", "close", 20), full("stddev_samp", "close", 20)
feature_query(
    "bollinger",
    ["mean_reversion"],
    {
        "bb_upper_20": f"({_MID}) + 2 * ({_SD})",
        "bb_lower_20": f"({_MID}) - 2 * ({_SD})",
        "bb_width_20": f"4 * ({_SD}) / nullif({_MID}, 0)",
        "bb_position_20": f"(close - ({_MID}) + 2 * ({_SD})) / nullif(4 * ({_SD}), 0)",
    },
)
_LL, _HH = full("min", "low", 14), full("max", "high", 14)
feature_query(
    "stochastic",
    ["mean_reversion"],
    {"stoch_k_14": "k", "stoch_d_14": full("avg", "k", 3)},
    base=f"SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS k FROM (SELECT *, {_LL} AS ll, {_HH} AS hh FROM raw)",
)
feature_query(
    "williams_r",
    ["mean_reversion"],
    {"williams_r_14": f"-100 * (({_HH}) - close) / nullif(({_HH}) - ({_LL}), 0)"},
)
feature_query(
    "cci",
    ["mean_reversion"],
    {"cci_20": "(tp - m) / nullif(0.015 * list_sum(list_transform(items, lambda v: abs(v - m))) / 20, 0)"},
    base=f"""SELECT *, {full('avg', 'tp', 20)} AS m, {full('list', 'tp', 20)} AS items
    FROM (SELECT *, (high + low + close) / 3 AS tp FROM raw)""",
)
_TR = f"""SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
FROM (SELECT *, {lag('close')} AS pc FROM raw)"""
_ATR = full("avg", "tr", 14)
feature_query(
    "atr", ["volatility_risk"], {"atr_14": _ATR, "atr_pct_14": f"({_ATR}) / nullif(close, 0)"}, base=_TR
)
feature_query(
    "volatility",
    ["volatility_risk"],
    {f"volatility_{n}": full("stddev_samp", "ret", n) for n in (20, 50)}
    | {f"volatility_annualized_{n}": f"({full('stddev_samp', 'ret', n)}) * {ANNUAL!r}" for n in (20, 50)},
    base=RETS,
    places=5,
)
feature_query(
    "rolling_var",
    ["volatility_risk"],
    {
        "var_95_20": full("quantile_cont({}, 0.05)", "ret", 20),
        "var_99_20": full("quantile_cont({}, 0.01)", "ret", 20),
    },
    base=RETS,
)
feature_query(
    "volume_stats",
    ["volume_liquidity"],
    {f"volume_ma_{n}": full("avg", "volume", n) for n in (20, 50)}
    | {f"volume_std_{n}": full("stddev_samp", "volume", n) for n in (20, 50)},
)
feature_query(
    "volume_spike",
    ["volume_liquidity"],
    {
        f"volume_spike_{n}": f"CAST(coalesce(volume > 2.0 * ({full('avg', 'volume', n)}), false) AS INTEGER)"
        for n in (20, 50)
    },
)
feature_query(
    "vwap",
    ["volume_liquidity"],
    {
        "volume_weighted_price": f"({full('sum', 'vc', 20)}) / nullif({full('sum', 'volume', 20)}, 0)",
        "volume_price_trend": f"vc / nullif({lag('vc')}, 0) - 1",
    },
    base="SELECT *, volume * close AS vc FROM raw",
    places=7,
)
feature_query(
    "impact",
    ["microstructure"],
    {
        "bid_ask_spread": "(high - low) / nullif(close, 0)",
        "spread_pct": "(high - low) / nullif(close, 0) / nullif(close, 0)",
        "price_impact": "abs(ret) / nullif(dv, 0)",
        "volume_impact": "dv / nullif(ret, 0)",
    },
    base=f"SELECT *, volume / nullif({lag('volume')}, 0) - 1 AS dv, close / nullif({lag('close')}, 0) - 1 AS ret FROM raw",
)
_RAVG, _RSTD = full("avg", "ret", 20), full("stddev_samp", "ret", 20)
feature_query(
    "efficiency_ratio", ["microstructure"], {"efficiency_ratio_20": f"({_RAVG}) / nullif({_RSTD}, 0)"}, base=RETS
)
feature_query(
    "trend_regime",
    ["volatility_risk", "regime"],
    {f"trend_up_{n}": f"CAST(coalesce(close > ({full('avg', 'close', n)}), false) AS INTEGER)" for n in (20, 50)}
    | {
        f"trend_strength_{n}": f"abs(close - ({full('avg', 'close', n)})) / nullif({full('avg', 'close', n)}, 0)"
        for n in (20, 50)
    },
)
feature_query(
    "liquidity_regime",
    ["volatility_risk", "regime"],
    {"high_liquidity_20": f"CAST(coalesce(volume > ({full('avg', 'volume', 20)}), false) AS INTEGER)"},
)
feature_query(
    "stop_levels",
    ["risk_execution"],
    {"stop_loss_long_14": f"close - 2.0 * ({_ATR})", "stop_loss_short_14": f"close + 2.0 * ({_ATR})"},
    base=_TR,
)
feature_query(
    "position_size",
    ["risk_execution"],
    {"position_size_20": f"1.0 / nullif(({_RSTD}) * {math.sqrt(1440)!r}, 0)"},
    base=RETS,
)
feature_query(
    "risk_adjusted_return",
    ["risk_execution"],
    {"risk_adjusted_return_20": f"ret * ({_RAVG}) / nullif({_RSTD}, 0)"},
    base=RETS,
)
feature_query(
    "documented_extras",
    ["extras"],
    {
        "zscore_20": f"(close - ({_MID})) / nullif({_SD}, 0)",
        "bb_bandwidth_20": f"4 * ({_SD}) / nullif({_MID}, 0)",
        "vwap_dist": f"close / nullif(({full('sum', 'vc', 20)}) / nullif({full('sum', 'volume', 20)}, 0), 0) - 1",
        "realized_vol_30": f"({full('stddev_samp', 'ret', 30)}) * {ANNUAL!r}",
        "downside_vol_30": f"CASE WHEN count(ret) OVER {frame(30)} = 30 THEN stddev_samp(CASE WHEN ret < 0 THEN ret END) OVER {frame(30)} END * {ANNUAL!r}",
        "vol_zscore_20": f"(volume - ({full('avg', 'volume', 20)})) / nullif({full('stddev_samp', 'volume', 20)}, 0)",
        "notional_volume": "vc",
        "notional_share_60": f"vc / nullif({full('sum', 'vc', 60)}, 0)",
        "hl_spread": "(high - low) / nullif(close, 0)",
        "oc_spread": "abs(open - close) / nullif(close, 0)",
        "kyle_lambda_proxy": "abs(ret) / nullif(vc, 0)",
        "roll_measure_proxy": f"CASE WHEN count(ret) OVER {frame(20)} = 20 THEN covar_samp(ret, ret1) OVER {frame(20)} END",
    },
    base=f"""SELECT *, {lag('ret')} AS ret1 FROM (
      SELECT *, volume * close AS vc, close / nullif({lag('close')}, 0) - 1 AS ret FROM raw)""",
    places=4,
)

feature_query(
    "second_engine_windows",
    ["trend_momentum", "volatility_risk", "volume_liquidity", "mean_reversion"],
    {
        **{f"ma_{n}": full("avg", "close", n) for n in (20, 60)},
        **{f"volatility_{n}": full("stddev_samp", "ret", n) for n in (20, 60)},
        **{f"volume_ma_{n}": full("avg", "volume", n) for n in (20, 60)},
        **{f"bb_upper_{n}": f"({full('avg', 'close', n)}) + 2 * ({full('stddev_samp', 'close', n)})" for n in (20, 60)},
        "momentum_60": f"close - {lag('close', 60)}",
    },
    base=RETS,
    cfg=FeatureConfig(ma=(20, 60), volatility=(20, 60), volume=(20, 60), bollinger=(20, 60), momentum=(60,)),
)

_HIGH_VOL = f"""WITH {TICK_BARS}, r AS ({RETS}),
v AS (SELECT symbol, ts, {full('stddev_samp', 'ret', 20)} AS v20, {full('stddev_samp', 'ret', 50)} AS v50 FROM r),
q AS (SELECT symbol, quantile_cont(v20, 0.8) AS q20, quantile_cont(v50, 0.8) AS q50 FROM v GROUP BY symbol)
SELECT symbol, ts, CAST(coalesce(v20 > q20, false) AS INTEGER) AS high_volatility_20,
       CAST(coalesce(v50 > q50, false) AS INTEGER) AS high_volatility_50
FROM v JOIN q USING (symbol)"""


@query("high_volatility", _HIGH_VOL)
def high_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute_features(tick_bars(spark, sf_dir), CFG, ["volatility_risk", "regime"])
    return shaped(df, ["high_volatility_20", "high_volatility_50"])


_SO_FAR = f"""WITH {TICK_BARS}, r AS ({RETS}), v AS (SELECT symbol, ts, {full('stddev_samp', 'ret', 20)} AS v20, {full('stddev_samp', 'ret', 50)} AS v50 FROM r)
SELECT symbol, ts, CAST(coalesce(v20 > quantile_cont(v20, 0.8) OVER w, false) AS INTEGER) AS high_volatility_20,
  CAST(coalesce(v50 > quantile_cont(v50, 0.8) OVER w, false) AS INTEGER) AS high_volatility_50 FROM v
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"""


@query("high_volatility_expanding", _SO_FAR)
def high_volatility_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = FeatureConfig(volatility_mode="expanding")
    df = compute_features(tick_bars(spark, sf_dir), cfg, ["volatility_risk", "regime"])
    return shaped(df, ["high_volatility_20", "high_volatility_50"])


_WINSOR = f"""WITH {TICK_BARS}, f AS (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret_1m,
  (high - low) / nullif(close, 0) AS hl_range FROM raw),
q AS (SELECT symbol, quantile_cont(ret_1m, 0.01) AS a1, quantile_cont(ret_1m, 0.99) AS b1,
  quantile_cont(hl_range, 0.01) AS a2, quantile_cont(hl_range, 0.99) AS b2 FROM f GROUP BY symbol)
SELECT symbol, ts, {rnd('CASE WHEN ret_1m IS NOT NULL THEN greatest(least(ret_1m, b1), a1) END')} AS ret_1m,
  {rnd('greatest(least(hl_range, b2), a2)')} AS hl_range FROM f JOIN q USING (symbol)"""


@query("winsorize", _WINSOR)
def winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute_features(tick_bars(spark, sf_dir), CFG, ["price_returns"])
    return shaped(winsorize(df, ["ret_1m", "hl_range"], 0.01), ["ret_1m", "hl_range"])


_VOL_PCT = f"""WITH {TICK_BARS}, r AS ({RETS}), v AS (SELECT symbol, ts, {full('stddev_samp', 'ret', 20)} AS vol FROM r),
l AS (SELECT *, count(vol) OVER {frame(200)} AS n, list(vol) OVER {frame(200)} AS vs FROM v)
SELECT symbol, ts, {rnd('vol')} AS vol,
  {rnd('CASE WHEN n = 200 THEN len(list_filter(vs, lambda x: x <= vol)) / 200.0 END')} AS vol_percentile FROM l"""


@query("vol_percentile", _VOL_PCT)
def vol_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = volatility_percentile(tick_bars(spark, sf_dir), window=200)
    return df.select(
        "symbol",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        rounded("vol").alias("vol"),
        rounded("vol_percentile").alias("vol_percentile"),
    )


# The longest window half of the longest series fills.
_VOL_PCT_LONG = f"""WITH {TICK_BARS}, r AS ({RETS}),
v AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, {full('stddev_samp', 'ret', 20)} AS vol FROM r),
w AS (SELECT max(rn) // 2 AS w FROM v),
c AS (SELECT a.symbol, a.ts, count(b.vol) AS n, count(b.vol) FILTER (b.vol <= a.vol) AS k FROM v a, w, v b
  WHERE b.symbol = a.symbol AND b.rn BETWEEN a.rn - w + 1 AND a.rn GROUP BY 1, 2)
SELECT symbol, ts, {rnd('vol')} AS vol, {rnd('CASE WHEN n = w AND rn >= w THEN k / w END')} AS vol_percentile FROM v JOIN c USING (symbol, ts), w"""


@query("vol_percentile_long", _VOL_PCT_LONG)
def vol_percentile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within the longest window that half of the longest series fills."""
    bars = tick_bars(spark, sf_dir)
    longest = bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 2
    df = volatility_percentile(bars, window=longest // 2)
    return df.select("symbol", "ts", rounded("vol").alias("vol"), rounded("vol_percentile").alias("vol_percentile"))


@query("feature_frame")
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families at once (the bench's main query)."""
    return compute_features(tick_bars(spark, sf_dir), CFG)


def _digest_sql() -> str:
    high = {f"high_volatility_{n}": f"high_volatility_{n}" for n in (20, 50)}
    parts = [*FRAME_PARTS, (high, _HIGH_VOL.replace(f"WITH {TICK_BARS}, ", "WITH "))]
    tables, cells = [], []
    for i, (columns, base) in enumerate(parts):
        values = ", ".join(f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in columns.items())
        tables.append(f"p{i} AS (SELECT symbol, {values} FROM ({base}))")
        cells.append(f"SELECT symbol, feature, value FROM p{i} UNPIVOT (value FOR feature IN ({', '.join(columns)}))")
    return f"""WITH {TICK_BARS}, {', '.join(tables)}, cells AS ({' UNION ALL '.join(cells)})
    SELECT symbol, feature, count(value) AS n, {rnd('min(value)')} AS low, {rnd('max(value)')} AS high FROM cells GROUP BY 1, 2"""


@query("feature_frame_digest", _digest_sql())
def feature_frame_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and range of every feature of the whole frame, per symbol."""
    frame = compute_features(tick_bars(spark, sf_dir), CFG)
    cells = long_form(frame, feature_names(CFG), ["symbol"])
    return (
        cells.groupBy("symbol", "feature")
        .agg(
            F.count("value").alias("n"),
            rounded(F.min("value")).alias("low"),
            rounded(F.max("value")).alias("high"),
        )
        .where("n > 0")
    )


_HOURLY_SET = f"""WITH {HOURLY_BARS}, g AS (SELECT *, coalesce(greatest(d, 0), 0) AS gain, coalesce(greatest(-d, 0), 0) AS loss
FROM (SELECT *, close - {lag('close')} AS d FROM bars))
SELECT symbol, ts, {rnd(full('avg', 'close', 20))} AS ma_20, {rnd(_rsi_sql(14))} AS rsi_14,
  {rnd(full('regr_slope({}, rn)', 'close', 240))} AS trend_slope_240
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM g)"""


@query("hourly_trend", _HOURLY_SET)
def hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute_features(hourly_bars(spark, sf_dir), CFG, ["trend_momentum"])
    return shaped(df, ["ma_20", "rsi_14", "trend_slope_240"])


_ALIGNED = f"""WITH {HOURLY_BARS}, r AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars),
d AS (SELECT ts, close AS close_driver, ret AS ret_driver FROM r WHERE symbol = 'click'),
j AS (SELECT r.symbol, r.ts, r.close, r.ret, close_driver, CASE WHEN r.ret IS NOT NULL THEN ret_driver END AS rd,
  CASE WHEN ret_driver IS NOT NULL THEN r.ret END AS rs, ret_driver FROM r JOIN d ON r.ts = d.ts WHERE r.symbol <> 'click')"""
_BETA = f"""{_ALIGNED} SELECT symbol, ts,
 {rnd(f"CASE WHEN count(rs) OVER {frame(100)} = 100 THEN covar_samp(rs, rd) OVER {frame(100)} / nullif(var_samp(rd) OVER {frame(100)}, 0) END")} AS beta
FROM j"""


@query("beta_to_driver", _BETA)
def beta_to_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = driver_features(hourly_bars(spark, sf_dir), "click", window=100)
    return df.select("symbol", "ts", rounded("beta_to_driver_100").alias("beta"))


_AS_OF = f"""WITH {TICK_BARS}, r AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM raw),
d AS (SELECT ts, close AS close_driver, ret AS ret_driver FROM r WHERE symbol = 'click'),
j AS (SELECT r.symbol, r.ts, r.close, r.ret, d.ts AS driver_ts, close_driver, ret_driver,
  CASE WHEN r.ret IS NOT NULL THEN ret_driver END AS rd, CASE WHEN ret_driver IS NOT NULL THEN r.ret END AS rs
  FROM r ASOF JOIN d ON r.ts >= d.ts WHERE r.symbol <> 'click' AND d.ts >= r.ts - INTERVAL 6 HOURS)"""


@query("driver_as_of", f"""{_AS_OF} SELECT symbol, ts, driver_ts, close_driver, {rnd('ret_driver')} AS ret_driver FROM j""")
def driver_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick bars next to the driver's last bar, for symbols that never trade in the same instant."""
    df = align_to_driver(tick_bars(spark, sf_dir), "click", tolerance="6 hours")
    return df.select("symbol", "ts", "driver_ts", "close_driver", rounded("ret_driver").alias("ret_driver"))


@query(
    "beta_to_driver_720",
    f"""{_AS_OF} SELECT symbol, ts,
 {rnd(f"CASE WHEN count(rs) OVER {frame(720)} = 720 THEN covar_samp(rs, rd) OVER {frame(720)} / nullif(var_samp(rd) OVER {frame(720)}, 0) END")} AS beta FROM j""",
)
def beta_to_driver_720(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = driver_features(tick_bars(spark, sf_dir), "click", tolerance="6 hours")
    return df.select("symbol", "ts", rounded("beta_to_driver_720").alias("beta"))


_PAIR = f"""{_ALIGNED}, p AS (SELECT *, close / nullif(close_driver, 0) AS ratio FROM j WHERE symbol = 'view')
SELECT ts, {rnd('ratio')} AS ratio,
 {rnd(f"(ratio - ({full('avg', 'ratio', 240)})) / nullif({full('stddev_samp', 'ratio', 240)}, 0)")} AS ratio_zscore,
 {rnd('ret - ret_driver')} AS return_diff FROM p"""


@query("pair_ratio_zscore", _PAIR)
def pair_ratio_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pair_features(hourly_bars(spark, sf_dir), "view", "click", window=240)
    return df.select("ts", *(rounded(c).alias(c) for c in ("ratio", "ratio_zscore", "return_diff")))


_DIFF = f"""{_ALIGNED} SELECT symbol, count(ret - ret_driver) AS n, {rnd('avg(ret - ret_driver)')} AS mean_diff,
 {rnd('stddev_samp(ret - ret_driver)')} AS std_diff FROM j GROUP BY symbol"""


@query("pair_return_diff", _DIFF)
def pair_return_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = driver_features(hourly_bars(spark, sf_dir), "click", window=100)
    diff = F.col("ret") - F.col("ret_driver")
    return df.groupBy("symbol").agg(
        F.count(diff).alias("n"),
        rounded(F.avg(diff)).alias("mean_diff"),
        rounded(F.stddev_samp(diff)).alias("std_diff"),
    )
