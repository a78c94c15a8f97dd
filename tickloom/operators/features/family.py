"""What a feature family declares: shared inputs, rolling windows, outputs.

Families do not build plans. The engine merges their declarations so that a
return series, a 20-bar mean or a lag used by several families is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.functions.rolling import Roll


@dataclass
class Family:
    lags: dict[str, tuple[Column, int]] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)
    rolls: set[Roll] = field(default_factory=set)
    ewm: dict[str, tuple[str, float, int]] = field(default_factory=dict)
    slopes: dict[str, tuple[str, int]] = field(default_factory=dict)
    outputs: dict[str, Column] = field(default_factory=dict)
    late_rolls: set[Roll] = field(default_factory=set)
    late_outputs: dict[str, Column] = field(default_factory=dict)

    def merge(self, other: "Family") -> "Family":
        return Family(
            {**self.lags, **other.lags},
            {**self.derived, **other.derived},
            self.rolls | other.rolls,
            {**self.ewm, **other.ewm},
            {**self.slopes, **other.slopes},
            {**self.outputs, **other.outputs},
            self.late_rolls | other.late_rolls,
            {**self.late_outputs, **other.late_outputs},
        )


# Shared inputs, as functions because columns need a running session. The first
# bar of a series has no previous bar: its return and true range are NULL, its
# gain and loss count as zero.


def bar_columns() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def close_lag() -> dict[str, tuple[Column, int]]:
    return {"_close_1": (F.col("close"), 1)}


def volume_lag() -> dict[str, tuple[Column, int]]:
    return {"_volume_1": (F.col("volume"), 1)}


def simple_return() -> dict[str, Column]:
    return {"_ret": ratio("close", "_close_1") - 1}


def volume_change() -> dict[str, Column]:
    return {"_volume_change": ratio("volume", "_volume_1") - 1}


def notional() -> dict[str, Column]:
    return {"_notional": F.col("volume") * F.col("close")}


def typical_price() -> dict[str, Column]:
    return {"_typical": (F.col("high") + F.col("low") + F.col("close")) / 3}


def true_range() -> dict[str, Column]:
    before = F.col("_close_1")
    widest = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    return {"_true_range": F.when(before.isNotNull(), widest)}


def gain_and_loss() -> dict[str, Column]:
    delta = F.col("close") - F.col("_close_1")
    return {
        "_gain": F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0)),
        "_loss": F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0)),
    }
