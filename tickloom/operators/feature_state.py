"""States of feature columns that add up: computed once per partition, merged on read.

One pass over a wide frame gives, for each group and task, three kinds of rows:

* moments of each column: rows, values, missing, infinite, mean, squared deviations, minimum, maximum;
* a histogram of each column whose bins are the leading bits of the value, with count, minimum and maximum of
  each bin, so bins of any two states are the same bins;
* on request, co-moments of each pair of columns over the rows that hold both.

All of them merge exactly (up to rounding of sums), so a statistic over the whole history needs the states of old
dates and the rows of new ones only. Quantiles are exact: merged histograms say which bin holds
each order statistic and how many values lie below it, and only the values of those bins are read again,
straight out of the wide frame; no column is unpivoted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import ratio
from tickloom.plans.small import join_small
from tickloom.session import durable

MOMENTS, BINS, PAIRS = 0, 1, 2
MANTISSA_BITS = 5  # bins a power of two: 32
CHUNK_ROWS = 20_000  # held at once by a Python worker, with several copies of their columns
# More values in a bin than this are split again before they are ordered.
MAX_BRACKET = 1_000_000
SPLITS = 4096

STATE = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("kind", "i", "j")]
    + [T.StructField(c, T.LongType()) for c in ("bin", "rows", "n", "missing", "infinite")]
    + [T.StructField(c, T.DoubleType()) for c in ("low", "high", "mean", "other", "squares", "others", "cross")]
)


def bin_of(values: np.ndarray) -> np.ndarray:
    """Sign, exponent and leading bits of doubles, as integers in the order of the values."""
    bits = (values + 0.0).view(np.int64)
    ordered = np.where(bits < 0, np.int64(-(2**63)) - bits, bits)
    return ordered >> (52 - MANTISSA_BITS)


def _moment_rows(x: np.ndarray) -> dict[str, np.ndarray]:
    missing, infinite = np.isnan(x).sum(0), np.isinf(x).sum(0)
    x = np.where(np.isfinite(x), x, np.nan)
    n = np.isfinite(x).sum(0)
    some = n > 0
    mean = np.divide(np.nansum(x, 0), n, out=np.zeros(x.shape[1]), where=some)
    out = {
        "i": np.arange(x.shape[1]), "rows": np.full(x.shape[1], len(x)), "n": n, "missing": missing, "infinite": infinite,
        "mean": np.where(some, mean, np.nan), "squares": np.nansum((x - mean) ** 2, 0),
        "low": np.nanmin(np.where(some, x, np.inf), 0, initial=np.inf), "high": np.nanmax(np.where(some, x, -np.inf), 0, initial=-np.inf),
    }
    for c in ("low", "high"):
        out[c] = np.where(some, out[c], np.nan)
    return out | {"kind": np.full(x.shape[1], MOMENTS)}


def _bin_rows(x: np.ndarray) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c in ("i", "bin", "n", "low", "high")}
    for i in range(x.shape[1]):
        values = np.sort(x[:, i][np.isfinite(x[:, i])])
        if len(values):
            codes = bin_of(values)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            last = np.append(first[1:], len(values)) - 1
            for c, v in (("i", np.full(len(first), i)), ("bin", codes[first]), ("n", last - first + 1), ("low", values[first]), ("high", values[last])):
                parts[c].append(v)
    out = {c: np.concatenate(v) if v else np.zeros(0) for c, v in parts.items()}
    return out | {"kind": np.full(len(out["i"]), BINS)}


def _pair_rows(x: np.ndarray) -> dict[str, np.ndarray]:
    mask = np.isfinite(x)
    m = mask.astype(float)
    centre = np.divide(np.where(mask, x, 0.0).sum(0), m.sum(0), out=np.zeros(x.shape[1]), where=mask.any(0))
    x = np.where(mask, x - centre, 0.0)
    n, sums, squares, cross = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
    i, j = np.triu_indices(x.shape[1], k=1)
    keep = n[i, j] > 0
    i, j = i[keep], j[keep]
    n, sx, sy = n[i, j], sums[i, j], sums[j, i]
    return {
        "i": i, "j": j, "n": n, "kind": np.full(len(i), PAIRS), "mean": centre[i] + sx / n, "other": centre[j] + sy / n,
        "squares": squares[i, j] - sx * sx / n, "others": squares[j, i] - sy * sy / n, "cross": cross[i, j] - sx * sy / n,
    }


def feature_states(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), pairs: bool = False, bins: bool = True) -> DataFrame:
    """The states of ``df``: ``keys`` and the columns of :data:`STATE`; ``i`` and ``j`` are places in ``columns``."""
    columns, keys = list(columns), list(keys)
    rows = df.select(*keys, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))
    shape = T.StructType([*(rows.schema[k] for k in keys), *STATE.fields])
    makers = [_moment_rows, *([_bin_rows] if bins else []), *([_pair_rows] if pairs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            x = np.column_stack([table.column(len(keys) + i).to_numpy() for i in range(len(columns))]).astype(float, copy=False)
            if keys:
                frame = table.select(keys).to_pandas()
                codes = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            else:
                codes = np.zeros(len(x), np.int64)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            for rows_ in np.split(order, starts[1:]):
                own = [table.column(k)[int(rows_[0])] for k in range(len(keys))]
                for make in makers:
                    made = make(x[rows_])
                    size = len(made["i"])
                    if not size:
                        continue
                    arrays = [pa.array([v.as_py()] * size, table.schema.field(k).type) for k, v in enumerate(own)]
                    for field in STATE.fields:
                        kind = {"integer": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[field.dataType.simpleString()]
                        if field.name not in made:
                            arrays.append(pa.nulls(size, kind))
                        elif kind == pa.float64():
                            arrays.append(pa.array(made[field.name].astype(float), kind, from_pandas=True))
                        else:
                            arrays.append(pa.array(made[field.name].astype(np.int64), pa.int64()).cast(kind))
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in shape.fields])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, shape)


def merged(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States with the same ``keys`` merged into one set; other columns of the states (a date, say) are summed over."""
    keys = list(keys)
    cells = states.select(*keys, *STATE.fieldNames())
    counts = [F.sum(c).alias(c) for c in ("rows", "n", "missing", "infinite")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    none = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    bins = cells.where(F.col("kind") == BINS).groupBy(*keys, "kind", "i", "j", "bin").agg(*counts, *ends, *none("mean", "other", "squares", "others", "cross"))
    # Means first, then deviations about them. States are few rows: one for each task and column or pair.
    at = [*keys, "kind", "i", "j", "bin"]
    same = Window.partitionBy(*at)
    weigh = lambda c: ratio(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0.0))).over(same), F.sum("n").over(same))
    centred = cells.where(F.col("kind") != BINS).withColumns({"_mean": weigh("mean"), "_other": weigh("other")})
    n, dx, dy = F.col("n"), F.col("mean") - F.col("_mean"), F.col("other") - F.col("_other")
    with_drift = lambda c, drift: F.sum(F.col(c) + F.coalesce(n * drift, F.lit(0.0))).alias(c)
    known = lambda c: F.when(F.count(c) > 0, F.first(f"_{c}")).alias(c)
    moments = centred.groupBy(*at).agg(
        *counts, *ends, known("mean"), known("other"), with_drift("squares", dx * dx), with_drift("others", dy * dy), with_drift("cross", dx * dy)
    )
    return bins.unionByName(moments).select(*keys, *STATE.fieldNames())


def _named(columns: Sequence[str], place: str = "i") -> Column:
    return F.get(F.array(*(F.lit(c) for c in columns)), F.col(place))


def column_summary(states: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, rows, count, nan_count, inf_count, mean, std, min, max`` from merged states; missing and infinite cells apart."""
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return states.where(F.col("kind") == MOMENTS).select(
        *keys, _named(columns).alias("feature"), "rows", F.col("n").alias("count"), F.col("missing").alias("nan_count"),
        F.col("infinite").alias("inf_count"), "mean", spread.alias("std"), F.col("low").alias("min"), F.col("high").alias("max"),
    )


def correlations(states: DataFrame, columns: Sequence[str], rounding: float) -> DataFrame:
    """``feature_a, feature_b, n, correlation`` from merged states with pairs; a column that is a rounded constant has none."""
    found = states.where(F.col("kind") == PAIRS)
    n = F.col("n")
    varies = lambda squares, mean: F.col(squares) > n * (rounding * F.col(mean)) ** 2
    r = F.when((n > 1) & varies("squares", "mean") & varies("others", "other"), F.col("cross") / (F.sqrt("squares") * F.sqrt("others")))
    # A pair that never meets has no state.
    names = F.array(*(F.lit(c) for c in columns))
    grid = states.where(F.col("kind") == MOMENTS).select("i")
    every = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1)))).where("i < j")
    values = found.select("i", "j", "n", r.alias("correlation"))
    return every.join(values, ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), F.coalesce("n", F.lit(0)).alias("n"), "correlation"
    )


def order_statistics(states: DataFrame, frame: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), max_bracket: int | None = None) -> DataFrame:
    """Exact quantiles: ``keys, feature, n, quantiles, below, above`` (arrays in the order of ``probs``).

    ``states`` are merged over ``keys`` and describe ``frame``, which is read once more for the values of the bins that
    hold an order statistic. Keys must not be null. ``below`` and ``above`` count the values on either side of each quantile.
    """
    keys, group = list(keys), [*keys, "i"]
    limit = MAX_BRACKET if max_bracket is None else max_bracket
    ranges = states.where(F.col("kind") == BINS).select(*group, F.col("bin").alias("at"), "n", "low", "high")
    upto = Window.partitionBy(*group).orderBy("low")
    placed = ranges.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*group))})
    ideal = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    lower = lambda p: F.floor(ideal(p)).cast("long")
    targets = []
    for k, p in enumerate(probs):
        targets.append(F.struct(F.lit(k).alias("k"), F.lit(0).alias("upper"), lower(p).alias("index")))
        targets.append(F.struct(F.lit(k).alias("k"), F.lit(1).alias("upper"), F.least(lower(p) + 1, F.col("total") - 1).alias("index")))
    inside = lambda t: (t["index"] >= F.col("before")) & (t["index"] < F.col("before") + F.col("n"))
    wanted = placed.withColumn("target", F.explode(F.filter(F.array(*targets), inside)))
    wanted = durable(wanted.select(*group, "total", "before", "n", "low", "high", "target.k", "target.upper", "target.index"))
    constant = wanted.where(F.col("low") == F.col("high"))
    settled = constant.select(*group, "total", "k", "upper", F.col("low").alias("value"), F.col("before").alias("under"), (F.col("before") + F.col("n")).alias("upto"))
    open_ = wanted.where(F.col("low") < F.col("high"))
    while True:
        brackets = open_.select(*group, "low", "high", "before", "n").distinct()
        largest = brackets.agg(F.max("n")).first()[0]
        if largest is None:
            break
        cells = bracketed(frame, columns, brackets.select(*group, "low", "high"), keys)
        if largest <= limit:
            counted = cells.groupBy(*group, "low", "value").agg(F.count("*").alias("c"))
            run = Window.partitionBy(*group, "low").orderBy("value")
            counted = counted.withColumn("seen", F.sum("c").over(run))
            hit = (F.col("index") >= F.col("before") + F.col("seen") - F.col("c")) & (F.col("index") < F.col("before") + F.col("seen"))
            found = open_.join(counted, [*group, "low"]).where(hit)
            settled = settled.unionByName(
                found.select(
                    *group, "total", "k", "upper", "value",
                    (F.col("before") + F.col("seen") - F.col("c")).alias("under"), (F.col("before") + F.col("seen")).alias("upto"),
                )
            )
            break
        # Split the brackets into many equal parts, by the same monotone arithmetic for every value.
        part = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * SPLITS)
        parts = cells.withColumn("part", part).groupBy(*group, "low", "part").agg(
            F.count("*").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        parts = parts.withColumn("seen", F.sum("m").over(Window.partitionBy(*group, "low").orderBy("part")))
        start = F.col("before") + F.col("seen") - F.col("m")
        hit = (F.col("index") >= start) & (F.col("index") < F.col("before") + F.col("seen"))
        finer = durable(
            open_.join(parts, [*group, "low"]).where(hit).select(*group, "total", start.alias("before"), F.col("m").alias("n"), F.col("lo").alias("low"), F.col("hi").alias("high"), "k", "upper", "index")
        )
        done = finer.where(F.col("low") == F.col("high"))
        settled = settled.unionByName(
            done.select(*group, "total", "k", "upper", F.col("low").alias("value"), F.col("before").alias("under"), (F.col("before") + F.col("n")).alias("upto"))
        )
        open_ = finer.where(F.col("low") < F.col("high"))
    side = lambda c, upper: F.max(F.when(F.col("upper") == upper, F.col(c)))
    both = settled.groupBy(*group, "k", "total").agg(
        side("value", 0).alias("a"), side("value", 1).alias("b"), side("under", 0).alias("under_a"), side("upto", 0).alias("upto_a"), side("upto", 1).alias("upto_b")
    )
    share = F.get(F.array(*(F.lit(float(p)) for p in probs)), F.col("k")) * (F.col("total") - 1)
    q = F.col("a") + (F.col("b") - F.col("a")) * (share - F.floor(share))
    both = both.withColumn("q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(q))
    below = F.when(F.col("q") > F.col("a"), F.col("upto_a")).otherwise(F.col("under_a"))
    not_above = F.when(F.col("q") >= F.col("b"), F.col("upto_b")).otherwise(F.col("upto_a"))
    out = both.groupBy(*group, "total").agg(F.sort_array(F.collect_list(F.struct("k", "q", below.alias("below"), (F.col("total") - not_above).alias("above")))).alias("all"))
    return out.select(
        *keys, _named(columns).alias("feature"), F.col("total").alias("n"), F.col("all.q").alias("quantiles"), F.col("all.below").alias("below"), F.col("all.above").alias("above")
    )


def bracketed(frame: DataFrame, columns: Sequence[str], brackets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, i, low, high, value``: the finite cells of the wide frame that lie in a bracket of their column.

    Each row looks at its cells where it is; only those inside a bracket (a few in a hundred) become rows.
    """
    by = list(keys) or ["_all"]
    brackets = brackets if keys else brackets.withColumn("_all", F.lit(0))
    per_column = brackets.groupBy(*by, "i").agg(F.collect_list(F.struct("low", "high")).alias("r"))
    per_key = per_column.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("_ranges"))
    rows = frame if keys else frame.withColumn("_all", F.lit(0))
    rows = join_small(rows.select(*by, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns))), per_key, by, "inner")

    def inside(i: int) -> Column:
        value = F.col(f"_c{i}")
        hits = F.filter(F.col("_ranges")[F.lit(i)], lambda r: (value >= r["low"]) & (value <= r["high"]))
        return F.transform(hits, lambda r: F.struct(F.lit(i).alias("i"), r["low"].alias("low"), r["high"].alias("high"), value.alias("value")))

    found = F.filter(F.array(*(inside(i) for i in range(len(columns)))), lambda x: x.isNotNull())
    cells = rows.select(*by, F.explode(F.flatten(found)).alias("cell"))
    return cells.select(*keys, "cell.*").where(F.abs("value") < math.inf)


def write_states(states: DataFrame, path: str) -> None:
    """One folder per date; the dates present replace those stored."""
    (
        states.repartitionByRange("date", "kind", "i", "bin")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)
    )


def dated_states(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), pairs: bool = False) -> DataFrame:
    """The merged states of each date (and ``keys``) of ``df``."""
    by = [*keys, "date"]
    return merged(feature_states(df, columns, by, pairs), by)

