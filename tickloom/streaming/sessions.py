"""Sessions on a stream in two stages, so that the ticks of a busy symbol meet nowhere.

First, ticks are counted per symbol and short bucket (no longer than the gap) with their first and last instant: an ordinary
windowed aggregate, combined on the map side, whose keys spread a busy symbol over tasks. Within a bucket no
gap can be long enough to part a session, so a bucket is one partial session. Then a stateful operator joins the
partial sessions of a symbol: one row per bucket reaches it, and its state is the sessions that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = np.dtype([("first", "<i8"), ("last", "<i8"), ("ticks", "<i8")])


def joined(parts: np.ndarray, gap: int) -> np.ndarray:
    """Partial sessions merged wherever less than ``gap`` lies between them."""
    parts = parts[np.argsort(parts["first"], kind="stable")]
    if not len(parts):
        return parts
    last = np.maximum.accumulate(parts["last"])
    starts = np.flatnonzero(np.append(True, parts["first"][1:] - last[:-1] >= gap))
    out = np.zeros(len(starts), STATE)
    out["first"] = parts["first"][starts]
    out["last"] = last[np.append(starts[1:], len(parts)) - 1]
    out["ticks"] = np.add.reduceat(parts["ticks"], starts)
    return out


class SessionJoiner(StatefulProcessor):
    """Open sessions of one symbol; each is given out when the watermark shows that nothing can extend it."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _read(self) -> np.ndarray:
        return np.frombuffer(bytes(self.open.get()[0]), STATE) if self.open.exists() else np.zeros(0, STATE)

    def _keep(self, sessions: np.ndarray) -> None:
        if len(sessions):
            self.open.update((sessions.tobytes(),))
            self.handle.registerTimer(int(-(-(sessions["last"].min() + self.gap) // 1000)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._read()]
        for pdf in rows:
            new = np.zeros(len(pdf), STATE)
            for c in STATE.names:
                new[c] = pdf[c].to_numpy(np.int64)
            parts.append(new)
        self._keep(joined(np.concatenate(parts), self.gap))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._read()
        # Buckets are given out once the watermark has passed their end, so an instant below it cannot come any more.
        over = sessions["last"] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000
        if over.any():
            done = sessions[over]
            self._keep(sessions[~over])
            yield pd.DataFrame(
                {
                    "symbol": np.full(len(done), key[0], object),
                    "session_start": done["first"].astype("datetime64[us]"),
                    "session_end": (done["last"] + self.gap).astype("datetime64[us]"),
                    "ticks": done["ticks"],
                }
            )


def stream_sessions(ticks: DataFrame, gap_minutes: int = 60, late: str = "10 minutes", bucket_minutes: int | None = None) -> DataFrame:
    """``symbol, session_start, session_end, ticks`` of a stream of (symbol, ts), each session once, when it is over.

    A session begins where the tick before is ``gap_minutes`` or more away. Needs the RocksDB state store.
    """
    bucket = min(bucket_minutes or max(1, gap_minutes // 4), gap_minutes)
    parts = (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{bucket} minutes").alias("w"), "symbol")
        .agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last"), F.count("*").alias("ticks"))
        .select("symbol", F.window_time("w").alias("seen"), "first", "last", "ticks")
    )
    return parts.groupBy("symbol").transformWithStateInPandas(
        SessionJoiner(gap_minutes * 60_000_000),
        "symbol string, session_start timestamp, session_end timestamp, ticks long",
        "append",
        "EventTime",
    )
