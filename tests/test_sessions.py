"""Partial sessions join to those of single ticks, whatever the buckets and batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.streaming.lookback import STORE
from tickloom.streaming.sessions import STATE, joined, stream_sessions


def parts_of(instants: np.ndarray, bucket: int) -> np.ndarray:
    out = []
    for b in np.unique(instants // bucket):
        own = instants[instants // bucket == b]
        out.append((own.min(), own.max(), len(own)))
    return np.array(out, STATE)


def brute(instants: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    t = np.sort(instants)
    cuts = np.flatnonzero(np.diff(t) >= gap) + 1
    return [(int(p[0]), int(p[-1]), len(p)) for p in np.split(t, cuts)]


@pytest.mark.parametrize("bucket", [1, 7, 20])
def test_joined_parts(bucket):
    rng = np.random.default_rng(bucket)
    instants = np.cumsum(rng.integers(0, 45, 400)) + 3
    parts = parts_of(instants, bucket)
    want = brute(instants, 20)
    assert [tuple(int(x) for x in s) for s in joined(parts[rng.permutation(len(parts))], 20)] == want
    # In two goes, as state and news.
    some = joined(parts[::2], 20)
    assert [tuple(int(x) for x in s) for s in joined(np.concatenate([some, parts[1::2]]), 20)] == want
    assert len(joined(parts[:0], 20)) == 0


def test_sessions_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    base = 1704067200
    seconds = {"hot": np.concatenate([np.arange(0, 4000, 7), np.arange(9000, 9500, 3)]), "few": np.array([10, 3609, 3611, 7300])}
    rows = [(s, int(base + t)) for s, ts in seconds.items() for t in ts]
    ticks = spark.createDataFrame(rows, "symbol string, t long").select("symbol", F.timestamp_seconds("t").alias("ts"), (F.col("t") - base).alias("t"))
    end = spark.createDataFrame([("~", base + 10**6)], "symbol string, t long").select("symbol", F.timestamp_seconds("t").alias("ts"), "t")
    ticks.limit(0).write.parquet(f"{tmp_path}/in")
    for part in (ticks.where("t < 3700"), ticks.where("t >= 3700"), end):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in").select("symbol", "ts")
        stream_sessions(source, 60, "2 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("symbol", F.unix_seconds("session_start").alias("a"), F.unix_seconds("session_end").alias("b"), "ticks")
    want = {(s, base + a, base + b + 3600, n) for s, ts in seconds.items() for a, b, n in brute(ts, 3600)}
    assert {tuple(r) for r in got.collect()} == want
