"""Full-window rolling aggregates and exponentially weighted means.

A rolling value exists only when its window holds ``n`` non-null inputs, so
every aggregate comes with the count of its input over the same frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

# (aggregate, column, window length)
Roll = tuple[str, str, int]

_AGGREGATES = {
    "avg": F.avg,
    "std": F.stddev_samp,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "list": F.collect_list,
    "autocov": lambda c: F.covar_samp(c, f"{c}_lag"),
    "sorted": F.collect_list,
}


def _name(kind: str, column: str, n: int) -> str:
    return f"_{kind}_{column.lstrip('_')}_{n}"


# Longer means, sums and deviations are assembled from blocks, see add_long_windows.
LONG_FRAME = 32
_BLOCK_KINDS = ("avg", "std", "sum")


def is_long(roll: Roll) -> bool:
    kind, _, n = roll
    return kind in _BLOCK_KINDS and n > LONG_FRAME


def rolled(kind: str, column: str, n: int) -> Column:
    """The guarded rolling value, once its parts have been added."""
    if is_long((kind, column, n)):
        return F.col(_name(kind, column, n))
    full = F.col(_name("count", column, n)) == n
    return F.when(full, F.col(_name(kind, column, n)))


def add_rolls(df: DataFrame, window: WindowSpec, rolls: Iterable[Roll]) -> DataFrame:
    """Add the raw aggregates and counts behind ``rolls`` in one window pass.

    The kind ``before_max`` looks at the ``n`` rows before the current one.
    """
    parts: dict[str, Column] = {}
    for kind, column, n in rolls:
        if kind == "before_max":
            frame = window.rowsBetween(-n, -1)
            parts[_name("before_count", column, n)] = F.count(column).over(frame)
            parts[_name(kind, column, n)] = F.max(column).over(frame)
            continue
        frame = window.rowsBetween(-(n - 1), 0)
        parts[_name("count", column, n)] = F.count(column).over(frame)
        value = _AGGREGATES[kind](column).over(frame)
        parts[_name(kind, column, n)] = F.sort_array(value) if kind == "sorted" else value
    return df.withColumns(parts) if parts else df


def rolled_quantile(column: str, n: int, q: float) -> Column:
    """Linearly interpolated quantile of a full window kept as kind ``sorted``."""
    items, rank = rolled("sorted", column, n), q * (n - 1)
    below = math.floor(rank)
    low, high = F.get(items, F.lit(below)), F.get(items, F.lit(min(below + 1, n - 1)))
    return low + (high - low) * (rank - below)


def previous_max(column: str, n: int) -> Column:
    """Guarded maximum over the ``n`` rows before the current one."""
    full = F.col(_name("before_count", column, n)) == n
    return F.when(full, F.col(_name("before_max", column, n)))


RADIX = 4


def ewm_levels(alpha: float, precision: float = 1e-16) -> int:
    """Block levels after which the dropped weights are below ``precision``."""
    if alpha >= 1.0:
        return 0
    length = math.log(precision) / math.log(1.0 - alpha)
    return max(1, math.ceil(math.log(length, RADIX)))


def ewm_lookback(alpha: float) -> int:
    return RADIX ** ewm_levels(alpha)


def _pieces(n: int) -> list[tuple[int, int, int]]:
    """Cut an ``n``-row frame into (level, length, rows after it), newest first."""
    pieces, after = [], 0
    for level in reversed(range(int(math.log2(n)) // 2 + 1)):
        size = RADIX**level
        while n - after >= size:
            pieces.append((level, size, after))
            after += size
    return pieces


# (length, rows after it, mean, sum of squared deviations, cross moment with position)
Block = tuple[int, int, Column, Column | None, Column | None]


def _join_blocks(blocks: list[Block]) -> tuple[Column, Column | None, Column | None]:
    """Mean, squared deviations and cross moment of adjacent blocks, newest first."""
    n = sum(block[0] for block in blocks)
    newest = blocks[0][2]
    shifts = [mean - newest for _, _, mean, _, _ in blocks]
    drift = sum((s * (b[0] / n) for s, b in zip(shifts, blocks)), F.lit(0.0))
    squares = cross = None
    if blocks[0][3] is not None:
        squares = F.lit(0.0)
        for s, (length, _, _, m2, _) in zip(shifts, blocks):
            squares = squares + m2 + (s - drift) * (s - drift) * length
    if blocks[0][4] is not None:
        cross = F.lit(0.0)
        for s, (length, after, _, _, c) in zip(shifts, blocks):
            # Distance of the block's centre from the frame's centre, in rows.
            offset = n / 2 - (after + length / 2)
            cross = cross + c + s * (length * offset)
    return newest + drift, squares, cross


def _join_pairs(left: list[Block], right: list[Block], moments: list[Column]) -> Column:
    """Co-moment of two columns over adjacent blocks, newest first, from those of the blocks."""
    n = sum(block[0] for block in left)
    centred = []
    for blocks in (left, right):
        newest = blocks[0][2]
        shifts = [block[2] - newest for block in blocks]
        drift = sum((s * (b[0] / n) for s, b in zip(shifts, blocks)), F.lit(0.0))
        centred.append([s - drift for s in shifts])
    total = F.lit(0.0)
    for block, moment, a, b in zip(left, moments, *centred):
        total = total + moment + a * b * block[0]
    return total


def add_long_windows(
    df: DataFrame,
    window: WindowSpec,
    ewm: dict[str, tuple[str, float, int]],
    slopes: dict[str, tuple[str, int]],
    rolls: Iterable[Roll] = (),
    pairs: dict[str, tuple[str, str, int]] | None = None,
) -> DataFrame:
    """Exponentially weighted means, slopes, means and deviations over long frames.

    A plain frame is re-read for every row, so 720 rows cost 720 updates each.
    Here a block of 4m rows is assembled from four blocks of m rows fetched by
    ``lag``; log4(L) passes over one shared sort replace an L-row frame, and
    all requests share each pass. Sums only add up and deviations and slopes use
    centred moments, so precision matches the direct computation. A frame that
    is not full, or holds a null, gives NULL.

    ``ewm`` maps an output to (column, alpha, min_periods) with normalised
    weights; its column must be non-null. ``slopes`` maps an output to
    (column, length): least squares against 0..length-1. ``rolls`` are avg, std
    or sum requests read back with :func:`rolled`. ``pairs`` maps an output to
    (column, column, length): their sample covariance; both must be null in the same
    rows. Expects ``_row`` for ``ewm``.
    """
    rolls, pairs = list(rolls), pairs or {}
    if not ewm and not slopes and not rolls and not pairs:
        return df
    depth = {name: ewm_levels(alpha) for name, (_, alpha, _) in ewm.items()}
    sloped = {c for c, _ in slopes.values()}
    spread = {c for kind, c, _ in rolls if kind == "std"}
    lengths: dict[str, int] = {}
    both = [(c, n) for x, y, n in pairs.values() for c in (x, y)]
    for c, n in [*slopes.values(), *((c, n) for _, c, n in rolls), *both]:
        lengths[c] = max(lengths.get(c, 1), n)
    top = {c: _pieces(n)[0][0] for c, n in lengths.items()}
    # A pair rises as far as its longest request, at most as far as its columns do.
    paired: dict[tuple[str, str], int] = {}
    for x, y, n in pairs.values():
        paired[x, y] = max(paired.get((x, y), 0), _pieces(n)[0][0])

    def moment(x: str, y: str, level: int, at: str = "") -> str:
        return f"_pair{level}_{x}_{y}{at}"

    def parts(c: str, level: int, at: str = "") -> tuple[str, str | None, str | None]:
        tag = f"{level}_{c}{at}"
        return (
            f"_mean{tag}",
            f"_square{tag}" if c in spread else None,
            f"_cross{tag}" if c in sloped else None,
        )

    state = {f"_s_{name}": F.col(c) for name, (c, _, _) in ewm.items()}
    for c in lengths:
        mean, square, cross = parts(c, 0)
        # NULL in, NULL out for every moment.
        state[mean] = F.col(c).cast("double")
        state |= {extra: F.col(c) * 0.0 for extra in (square, cross) if extra}
    state |= {moment(x, y, 0): F.col(x) * F.col(y) * 0.0 for x, y in paired}
    df = df.withColumns(state)
    for level in range(max([0, *top.values(), *depth.values()])):
        size = RADIX**level
        grown: dict[str, Column] = {}
        for name, (_, alpha, _) in ewm.items():
            if level < depth[name]:
                total = F.col(f"_s_{name}")
                for k in range(1, RADIX):
                    weight = (1.0 - alpha) ** (k * size)
                    total = total + weight * F.lag(f"_s_{name}", k * size, 0.0).over(window)
                grown[f"_s_{name}"] = total
        rising = [c for c in lengths if level < top[c]]
        for c in rising:
            for part in filter(None, parts(c, level)):
                for k in range(1, RADIX):
                    grown[f"{part}_{k}"] = F.lag(part, k * size).over(window)
        growing = [(x, y) for (x, y), highest in paired.items() if level < highest]
        for x, y in growing:
            part = moment(x, y, level)
            grown |= {f"{part}_{k}": F.lag(part, k * size).over(window) for k in range(1, RADIX)}
        df = df.withColumns(grown)
        raised: dict[str, Column] = {}

        def four(c: str) -> list[Block]:
            return [
                (size, k * size, *(F.col(p + (f"_{k}" if k else "")) if p else None for p in parts(c, level)))
                for k in range(RADIX)
            ]

        for c in rising:
            for target, value in zip(parts(c, level + 1), _join_blocks(four(c))):
                if target:
                    raised[target] = value
        for x, y in growing:
            part = moment(x, y, level)
            moments = [F.col(part + (f"_{k}" if k else "")) for k in range(RADIX)]
            raised[moment(x, y, level + 1)] = _join_pairs(four(x), four(y), moments)
        df = df.withColumns(raised) if raised else df
    fetched: dict[str, Column] = {}

    def blocks_of(c: str, n: int) -> list[Block]:
        blocks: list[Block] = []
        for level, length, after in _pieces(n):
            names = parts(c, level)
            if after:
                moved = parts(c, level, f"_at{after}")
                for source, target in zip(names, moved):
                    if source:
                        fetched[target] = F.lag(source, after).over(window)
                names = moved
            blocks.append((length, after, *(F.col(p) if p else None for p in names)))
        return blocks

    def whole(c: str, n: int) -> tuple[Column, Column | None, Column | None]:
        return _join_blocks(blocks_of(c, n))

    def whole_pair(x: str, y: str, n: int) -> Column:
        moments = []
        for level, _, after in _pieces(n):
            source = moment(x, y, level)
            if after:
                fetched[moment(x, y, level, f"_at{after}")] = F.lag(source, after).over(window)
                source = moment(x, y, level, f"_at{after}")
            moments.append(F.col(source))
        return _join_pairs(blocks_of(x, n), blocks_of(y, n), moments)

    results: dict[str, Column] = {name: whole_pair(x, y, n) / (n - 1) for name, (x, y, n) in pairs.items()}
    for name, (c, n) in slopes.items():
        results[name] = whole(c, n)[2] / (n * (n * n - 1) / 12)
    for kind, c, n in rolls:
        mean, square, _ = whole(c, n)
        results[_name(kind, c, n)] = (
            F.sqrt(square / (n - 1)) if kind == "std" else mean * n if kind == "sum" else mean
        )
    for name, (_, alpha, periods) in ewm.items():
        decay = 1.0 - alpha
        covered = F.least(F.col("_row"), F.lit(ewm_lookback(alpha)))
        weights = (1 - F.pow(F.lit(decay), covered)) / alpha
        results[name] = F.when(F.col("_row") >= periods, F.col(f"_s_{name}") / weights)
    scratch = [c for c in df.columns if c.startswith(("_s_", "_mean", "_square", "_cross", "_pair"))]
    return df.withColumns(fetched).withColumns(results).drop(*scratch, *fetched)
