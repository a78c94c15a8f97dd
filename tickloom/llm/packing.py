"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Only the histogram of piece lengths (one row per length up to ``capacity``) goes
to the driver. There the configuration linear program (which mixtures of lengths
fill a sequence, and how often) is solved approximately by multiplicative weights:
a knapsack dynamic program prices the best configuration for the current weights,
and lengths already covered lose weight. Configurations are rounded down; what
remains is placed best-fit decreasing on the histogram. Spark ranks the pieces of
each length and looks up the sequence and offset of each rank.

Defined results: a null text is empty and holds the end id alone; rows that repeat
a doc_id are documents of their own; an empty table gives no pieces. A document
longer than ``capacity`` is cut into pieces of ``capacity``, the first one shorter
if need be. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.bpe import byte_bpe
from tickloom.llm.store import stored

ROUNDS = 400  # multiplicative-weights steps
STEP = 0.5  # learning rate of the weights


def best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length (ascending) occurs in the most valuable mixture that fits: unbounded knapsack."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = usable[c]
        best[c], choice[c] = best[c - 1], -1
        if k:
            gain = best[c - lengths[:k]] + values[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], choice[c] = gain[i], i
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return counts


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) pairs that hold every piece of the histogram exactly once."""
    lengths = np.array(sorted(length for length, n in histogram.items() if n > 0), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    # Full pieces are sequences of their own.
    if len(lengths) and lengths[-1] == capacity:
        out.append(({int(capacity): 1}, int(need[-1])))
        lengths, need = lengths[:-1], need[:-1]
    if len(lengths):
        found = _fractional(lengths, need, capacity, rounds)
        left = need.copy()
        for counts, times in found:
            used = counts > 0
            whole = int(min(np.floor(times), (left[used] // counts[used]).min()))
            if whole > 0:
                left -= whole * counts
                out.append(({int(x): int(a) for x, a in zip(lengths[used], counts[used], strict=True)}, whole))
        out += _best_fit(lengths, left, capacity)
    return out


def _fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, float]]:
    """Configurations with fractional multiplicities that together use no length more often than it occurs."""
    covered = np.zeros(len(lengths))
    size = lengths / capacity
    patterns: dict[bytes, list] = {}
    lowest = max(1.0, float((lengths * need).sum()) / capacity)
    for _ in range(rounds):
        # Weights start at the size of a piece, the dual values of a program without waste.
        counts = best_configuration(lengths, size * np.exp(-STEP * (covered - covered.min())), capacity)
        used = counts > 0
        if not used.any():
            break
        times = float(np.minimum(need[used] / counts[used], lowest).min())
        covered += counts * times / need
        entry = patterns.setdefault(counts.tobytes(), [counts, 0.0])
        entry[1] += times
    scale = max(1.0, float(covered.max(initial=0.0)))
    ready = [(counts, times / scale) for counts, times in patterns.values()]
    return sorted(ready, key=lambda x: (-x[1], x[0].tobytes()))


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over whole groups of equal sequences."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for x, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        while n > 0:
            fits = np.flatnonzero(rooms[x:])
            if len(fits):
                room = int(fits[0]) + x
                config, times = groups[room].pop()
                take = min(n, times)
                if take < times:
                    groups[room].append((config, times - take))
                rooms[room] = bool(groups[room])
                _add(groups, rooms, room - x, {**config, x: config.get(x, 0) + 1}, take)
                n -= take
            else:
                each = capacity // x
                full, rest = divmod(n, each)
                if full:
                    _add(groups, rooms, capacity - each * x, {x: each}, full)
                if rest:
                    _add(groups, rooms, capacity - rest * x, {x: rest}, 1)
                n = 0
    return [entry for room in sorted(groups) for entry in groups[room]]


def _add(groups: dict, rooms: np.ndarray, room: int, config: dict[int, int], times: int) -> None:
    groups.setdefault(room, []).append((config, times))
    rooms[room] = True


class Slots:
    """Where the pieces of each length go, by rank: a table bounded by the capacity, not by the corpus."""

    def __init__(self, configs: list[tuple[dict[int, int], int]]):
        rows, used, base = [], {}, 0
        for config, times in configs:
            offset = 0
            for length in sorted(config, reverse=True):
                each = config[length]
                rows.append((length, used.get(length, 0), each, base, offset))
                used[length] = used.get(length, 0) + each * times
                offset += each * length
            base += times
        self.sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.base, self.offset = table.T
        self.key = self._key(self.length, self.first)

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length.astype(np.int64) << 48) + rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        within = rank - self.first[i]
        return self.base[i] + within // self.each[i], self.offset[i] + within % self.each[i] * length


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long, part int, local long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, keep: tuple[str, ...], with_ids: bool) -> DataFrame:
    """Tokenize and cut; each piece carries its rank among the pieces of its length in its input partition."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            row, piece, start, length, crc, ids, local = [], [], [], [], [], [], []
            for i in range(len(column)):
                tokens = np.concatenate([bpe.encode(column[i].as_py()).astype("<u4"), end])
                at, k = 0, 0
                while at < len(tokens):
                    size = (len(tokens) - at) % capacity or capacity
                    part_ids = tokens[at : at + size]
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(part_ids.tobytes()))
                    local.append(seen[size])
                    seen[size] += 1
                    if with_ids:
                        ids.append(part_ids.astype(np.int32))
                    at, k = at + size, k + 1
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).take(pa.array(row, pa.int64()))
            arrays = [
                *kept.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(local, pa.int64()),
            ]
            names = [*kept.schema.names, "piece", "start", "length", "ids_crc32", "part", "local"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, f"{fields}, {PIECE_SCHEMA}" + (", ids array<int>" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: ``keep`` columns, ``piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``."""
    spark = docs.sparkSession
    cut = stored(cut_pieces(docs, path, capacity, end_id, text, keep, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most one row for each length up to the capacity.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(configurations(histogram, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("part")
    base = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    names = [*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = table.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    shape = cut.select(*names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    return ranked.select(*names, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")
