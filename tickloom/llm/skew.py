"""Joins of many rows with one row per key, safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is split when it holds more than one part in PARTS of all rows: at most PARTS keys do.
PARTS = 400


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``left`` joined to ``right`` (unique by ``key``); hot keys of ``left`` are salted.

    A key holding n of N rows is dealt over ceil(n * parts / N) salts and its one
    right row is copied as often, so copies number at most ``parts`` plus one per
    hot key. ``spread`` is any column that varies over the rows of a key.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(1, -(-total // parts))
    hot = counts.where(F.col("_n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    many = left.join(hot, left[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")
    )
    one = right.join(hot, right[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return many.drop("_hot", "_salts").join(one.drop("_hot", "_salts"), [key, "_salt"], how).drop("_salt")
