"""A stored feature table that is updated by date and read as if it had been computed whole.

Bounded features of a bar depend on the bars shortly before it, so new dates need little history. High-volatility
flags and winsorised values depend on quantiles over a symbol's whole history, which every new date
moves. So they are not stored: beside the dates lies the state of the columns they depend on (counts, moments and a
histogram for each symbol and date), an update adds the states of its dates, finds the exact quantiles
from all of them, and writes one row of limits for each symbol. Reading joins the limits and derives those columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import FeatureConfig
from tickloom.functions.numeric import clip, flag
from tickloom.operators.feature_state import dated_states, merged, order_statistics, write_states
from tickloom.operators.features import compute_features, lookback_bars
from tickloom.operators.features.families import FAMILIES
from tickloom.plans.small import join_small
from tickloom.session import durable
from tickloom.sources.writers import with_history


@dataclass(frozen=True)
class FeatureTable:
    """``path`` holds ``features`` and ``states`` by date, and ``limits``. Needs the sample-wide volatility mode."""

    path: str
    cfg: FeatureConfig = field(default_factory=FeatureConfig)
    families: Sequence[str] = tuple(FAMILIES)
    winsorized: Sequence[str] = ()
    fraction: float = 0.01

    @property
    def flagged(self) -> list[str]:
        return [f"volatility_{n}" for n in self.cfg.volatility] if "regime" in self.families else []

    @property
    def probabilities(self) -> list[float]:
        return [self.cfg.volatility_quantile, self.fraction, 1 - self.fraction]

    def _watched(self) -> list[str]:
        return [*self.flagged, *(c for c in self.winsorized if c not in self.flagged)]

    def update(self, spark: SparkSession, bars_path: str, since: date | None = None) -> None:
        """Recompute the dates from ``since`` on (all without it) out of the stored bars (``date`` partitions).

        Reads those dates and, per symbol, the bars their look-back needs; of older features only the values that
        decide a quantile.
        """
        if self.flagged and self.cfg.volatility_mode != "full_sample":
            raise ValueError("limits of a feature table are those of the whole sample")
        bars = spark.read.parquet(bars_path)
        recent = bars if since is None else with_history(bars, since, lookback_bars(self.cfg, self.families))
        fresh = compute_features(recent, self.cfg, self.families, whole_history=False)
        fresh = fresh if since is None else fresh.where(F.col("date") >= F.lit(since))
        (
            fresh.repartitionByRange("date", "symbol", "ts")
            .sortWithinPartitions("date", "symbol", "ts")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(f"{self.path}/features")
        )
        watched = self._watched()
        if not watched:
            return
        stored = spark.read.parquet(f"{self.path}/features")
        new = stored if since is None else stored.where(F.col("date") >= F.lit(since))
        write_states(dated_states(new, watched, ["symbol"]), f"{self.path}/states")
        states = durable(merged(spark.read.parquet(f"{self.path}/states").drop("date"), ["symbol"]))
        limits = order_statistics(states, stored, watched, self.probabilities, ["symbol"])
        wide = limits.groupBy("symbol").pivot("feature", watched).agg(F.first("quantiles"))
        wide.select("symbol", *(F.col(c).alias(f"_lim_{c}") for c in watched)).write.mode("overwrite").parquet(f"{self.path}/limits")

    def read(self, spark: SparkSession) -> DataFrame:
        """Every stored row with all its features, as a full run over the same bars gives them."""
        stored = spark.read.parquet(f"{self.path}/features")
        watched = self._watched()
        if not watched:
            return stored
        joined = join_small(stored, spark.read.parquet(f"{self.path}/limits"), ["symbol"])
        limit = lambda c, k: F.get(f"_lim_{c}", F.lit(k))
        flags = {f"high_{c}": flag(F.col(c) > limit(c, 0)) for c in self.flagged}
        clipped = {c: clip(F.col(c), limit(c, 1), limit(c, 2)) for c in self.winsorized}
        return joined.withColumns(flags).withColumns(clipped).drop(*(f"_lim_{c}" for c in watched))
