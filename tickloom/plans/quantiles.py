"""Exact quantiles of arbitrarily large groups.

``percentile`` keeps every distinct value of a group in one task. That is the
right tool for small groups; for large ones a mergeable sketch brackets the two
order statistics each quantile needs, exact counts place the bracket, and only
the rows inside it (a fraction of about 4 / accuracy) are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import count_if
from tickloom.plans.small import join_small

MAX_GROUP_ROWS = 5_000_000
ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    max_group_rows: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``keys + quantiles array<double>`` with linear interpolation, nulls ignored."""
    return aggregate_with_quantiles(
        df, keys, value, [], probs, max_group_rows=max_group_rows, accuracy=accuracy
    )


def aggregate_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    aggregates: Sequence[Column],
    probs: Sequence[float],
    *,
    max_group_rows: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``aggregates`` per group plus its quantiles; one pass when groups are small.

    Group sizes are counted with nulls included: an upper bound that does not
    need the value column, so whatever computes it is pruned from that job.
    """
    keys = list(keys)
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    number = F.col(value).cast("double")
    if longest <= (MAX_GROUP_ROWS if max_group_rows is None else max_group_rows):
        wanted = F.array(*(F.lit(float(p)) for p in probs))
        grouped = df.groupBy(*keys).agg(*aggregates, F.percentile(number, wanted).alias("quantiles"))
        return grouped if aggregates else grouped.where(F.col("quantiles").isNotNull())
    values = df.where(F.col(value).isNotNull()).select(*keys, number.alias("v"))
    found = _bracketed(values, keys, probs, accuracy)
    return df.groupBy(*keys).agg(*aggregates).join(found, keys, "left") if aggregates else found


def _bracketed(values: DataFrame, keys: list[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    margin = 2.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("v", [float(e) for e in edges], accuracy).alias("edges"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
    )
    bracket = F.array(
        *(
            F.struct(
                F.lit(i).alias("q"),
                F.lit(float(p)).alias("p"),
                # Open to the extremes at the ends, where order statistics meet the edge.
                (F.col("lowest") if edges[2 * i] <= 0.0 else F.get("edges", F.lit(2 * i))).alias("lo"),
                (F.col("highest") if edges[2 * i + 1] >= 1.0 else F.get("edges", F.lit(2 * i + 1))).alias("hi"),
            )
            for i, p in enumerate(probs)
        )
    )
    brackets = sketch.select(*keys, "n", F.explode(bracket).alias("b")).select(*keys, "n", "b.*")
    packed = brackets.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("q", "lo", "hi"))).alias("bs")
    )
    tagged = join_small(values, packed, keys, "inner")
    below = (
        tagged.groupBy(*keys)
        .agg(F.array(*(count_if(F.col("v") < F.get("bs", F.lit(i))["lo"]) for i in range(len(probs)))).alias("b"))
        .select(*keys, F.posexplode("b").alias("q", "below"))
    )
    inside = (
        tagged.select(
            *keys, "v", F.explode(F.filter("bs", lambda b: F.col("v").between(b["lo"], b["hi"]))).alias("b")
        )
        .groupBy(*keys, F.col("b.q").alias("q"), "v")
        .agg(F.count("*").alias("m"))
    )
    walk = Window.partitionBy(*keys, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("m").over(walk)).join(below, [*keys, "q"]).join(
        brackets.select(*keys, "q", "p", "n"), [*keys, "q"]
    )
    rank = F.col("p") * (F.col("n") - 1)
    low_rank, high_rank = F.floor(rank), F.ceil(rank)
    end = F.col("below") + F.col("upto")
    picked = ranked.groupBy(*keys, "q", "p", "n").agg(
        F.min(F.when(end > low_rank, F.col("v"))).alias("a"),
        F.min(F.when(end > high_rank, F.col("v"))).alias("b"),
    )
    point = F.col("a") + (F.col("b") - F.col("a")) * (rank - low_rank)
    return (
        picked.select(*keys, "q", point.alias("x"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("q", "x"))).alias("xs"))
        .select(*keys, F.col("xs.x").alias("quantiles"))
    )
