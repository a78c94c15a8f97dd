"""Rolling features on a stream, from the last bars of each series kept as state.

A stateful operator holds, per series, the bars that may still change (younger than the watermark) and a ring
of the last ``lookback`` final ones. Once the watermark has passed a bar, it is given out in order, after
the bars of the ring, marked as borrowed. A micro-batch is then an ordinary table in which every new bar has its
history, so the batch code computes its features: the same plan, no second implementation, and no
stored history is read again. A bar that comes late, but before the watermark, takes its place among the waiting
ones, so features are computed once, on the final order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.config import FeatureConfig
from tickloom.operators.features import compute_features, lookback_bars
from tickloom.session import durable

FIELDS = ("open", "high", "low", "close", "volume")
STATE = np.dtype([("ts", "<i8"), ("values", "<f8", (len(FIELDS),))])
BORROWED = "borrowed"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lookback(StatefulProcessor):
    """Ring and waiting bars of one series, each as one packed value.

    A timer at the first waiting bar fires when the watermark has passed it. With ``idle`` a further one, that long
    after the last final bar, drops the ring of a series that has gone quiet; should it come
    back it starts anew.
    """

    def __init__(self, keys: Sequence[str], kinds: dict[str, str], lookback: int, idle_ms: int | None):
        self.keys, self.kinds, self.lookback, self.idle_ms = list(keys), kinds, lookback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "bars binary")
        self.waiting = handle.getValueState("waiting", "bars binary")

    @staticmethod
    def _read(state) -> np.ndarray:
        return np.frombuffer(bytes(state.get()[0]), STATE) if state.exists() else np.zeros(0, STATE)

    @staticmethod
    def _write(state, bars: np.ndarray) -> None:
        if len(bars):
            state.update((bars.tobytes(),))
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._read(self.waiting)]
        for pdf in rows:
            new = np.zeros(len(pdf), STATE)
            new["ts"] = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
            new["values"] = pdf[list(FIELDS)].to_numpy(float)
            parts.append(new)
        bars = np.concatenate(parts)
        bars = bars[np.argsort(bars["ts"], kind="stable")]
        # Of bars of one instant the one that came last counts.
        bars = bars[np.append(bars["ts"][1:] != bars["ts"][:-1], True)]
        self._write(self.waiting, bars)
        self.handle.registerTimer(int(-(-bars["ts"][0] // 1000)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ring, waiting = self._read(self.ring), self._read(self.waiting)
        final = int(np.searchsorted(waiting["ts"], watermark * 1000, side="right"))
        if final:
            bars = np.concatenate([ring, waiting[:final]])
            self._write(self.ring, bars[-self.lookback :] if self.lookback else bars[:0])
            self._write(self.waiting, waiting[final:])
            if final < len(waiting):
                self.handle.registerTimer(int(-(-waiting["ts"][final] // 1000)))
            if self.idle_ms is not None:
                self.handle.registerTimer(int(bars["ts"][-1] // 1000) + self.idle_ms)
            yield self._frame(key, bars, len(ring))
        elif self.idle_ms is not None and len(ring) and ring["ts"][-1] // 1000 + self.idle_ms <= watermark:
            self.ring.clear()

    def _frame(self, key, bars: np.ndarray, borrowed: int) -> pd.DataFrame:
        out = {k: np.full(len(bars), v, object) for k, v in zip(self.keys, key, strict=True)}
        out["ts"] = bars["ts"].astype("datetime64[us]")
        out |= {f: bars["values"][:, i] for i, f in enumerate(FIELDS)}
        out[BORROWED] = np.arange(len(bars)) < borrowed
        return pd.DataFrame(out)


def with_lookback(
    bars: DataFrame, lookback: int, late: str, keys: Sequence[str] = ("symbol",), idle_ms: int | None = None
) -> DataFrame:
    """The final bars of a stream, in each micro-batch after the ``lookback`` bars before them (``borrowed``).

    ``bars``: keys, ts (timestamp), open, high, low, close, volume. Bars later than ``late`` are dropped by the
    watermark. More than one key keeps a ring for each combination, such as a symbol's timeframes.
    Needs the RocksDB state store (:data:`STORE`).
    """
    picked = bars.select(*keys, "ts", *(F.col(c).cast("double").alias(c) for c in FIELDS)).withWatermark("ts", late)
    kinds = {k: picked.schema[k].dataType.simpleString() for k in keys}
    fields = ", ".join(f"`{k}` {kind}" for k, kind in kinds.items())
    return picked.groupBy(*keys).transformWithStateInPandas(
        Lookback(keys, kinds, lookback, idle_ms),
        f"{fields}, ts timestamp, {', '.join(f'{c} double' for c in FIELDS)}, {BORROWED} boolean",
        "append",
        "EventTime",
    )


def feature_sink(
    path: str, cfg: FeatureConfig | None = None, families: Sequence[str] = ("price_returns", "trend_momentum"), columns: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: features of the final bars (all, or ``columns`` alone), one folder per micro-batch.

    A micro-batch that is run again replaces its folder, so each bar is stored once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        # The stateful operator runs once; what follows reads its result several times.
        bars = durable(batch)
        if not bars.isEmpty():
            fresh = compute_features(bars, cfg, families).where(~F.col(BORROWED)).drop(BORROWED)
            fresh = fresh.select("symbol", "ts", *columns) if columns else fresh
            fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def stream_features(
    spark: SparkSession,
    bars: DataFrame,
    path: str,
    checkpoint: str,
    late: str,
    cfg: FeatureConfig | None = None,
    families: Sequence[str] = ("price_returns", "trend_momentum"),
    idle_ms: int | None = None,
    columns: Sequence[str] = (),
):
    """Start the query: a stream of bars in, the features of every final bar out (started, available data only)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    final = with_lookback(bars, lookback_bars(cfg, families), late, idle_ms=idle_ms)
    return (
        final.writeStream.foreachBatch(feature_sink(path, cfg, families, columns))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
