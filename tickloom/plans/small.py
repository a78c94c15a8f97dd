"""Joins against tables that are expected, but not promised, to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Broadcast ``small`` only after checking its row count.

    The rows are computed once and held as a local relation; beyond the bound
    the join is a shuffled one and AQE splits skewed keys.
    """
    rows = small.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        return df.join(small, list(on), how)
    local = df.sparkSession.createDataFrame(rows, small.schema)
    return df.join(F.broadcast(local), list(on), how)
