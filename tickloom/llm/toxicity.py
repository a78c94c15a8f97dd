"""Toxicity by FTRL-proximal logistic regression over hashed words, n-grams and skip-grams.

Features of a text: each distinct lower-cased word, word beginning of 4, 5 or 7 bytes (for
inflected words), pair of neighbours and pair with one word between, hashed into
2 ** ``BITS`` coordinates. FTRL-proximal gives every
coordinate a learning rate of its own and, by its L1 term, leaves most of them at
zero; the weights that are not zero are few and are broadcast.

The fit uses a bounded, documented sample of labelled rows (``max_rows``, drawn by
hash over all labelled rows, each text once). Several tasks run FTRL on their part of
it, and their states are averaged after every pass (parameter mixing). The sample is dealt to
them once and kept there; a pass's state is given up as soon as the next one is known.

Defined results: a null, empty or wordless text has the score of the bias alone; a
score of 0.5 or more predicts 1. Rows without a label are not learned from; rows that
repeat a text count once per label. Without labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import column, hash_spans, lower_ascii, mix, pieces, spans

BITS = 20
MAX_ROWS = 20_000
PARTS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0, 0.1
BEGINNINGS = (4, 5, 7)
BLOCK = 1 << 12  # coordinates that go together in a row
MOVED = "block int, z binary, n binary"

# ASCII letters and digits, and every byte of the other letters.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per piece: (number of texts, coordinates of all, where each text's begin, with an end); distinct within a text."""
    for piece in pieces(texts):
        low = lower_ascii(piece.buf)
        starts, ends = spans(_WORD[low[: piece.size]], piece.edges())
        h, owner = hash_spans(low, starts, ends), piece.owner(starts)
        found, of = [h], [owner]
        for gap, salt in ((1, 0x51ED), (2, 0xA3C7)):
            if len(h) > gap:
                same = owner[gap:] == owner[:-gap]
                found.append(mix(mix(h[:-gap] + np.uint64(salt)) ^ h[gap:])[same])
                of.append(owner[gap:][same])
        for size in BEGINNINGS:
            longer = ends - starts > size
            found.append(mix(hash_spans(low, starts[longer], starts[longer] + size) + np.uint64(0x1E61)))
            of.append(owner[longer])
        slot, owner = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)
        both = np.unique((owner << BITS) | slot)
        yield piece.n, both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(piece.n + 1))


def weights_of(at: np.ndarray, z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the sums stand for; the bias is not drawn to zero."""
    rate = (BETA + np.sqrt(n)) / ALPHA + L2
    l1 = np.where(at == 1 << BITS, 0.0, L1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)


class Ftrl:
    """State of the learner: per coordinate the sums z and n; the last coordinate is the bias."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z, self.n = (np.zeros((1 << BITS) + 1) if x is None else x.copy() for x in (z, n))

    def weights(self, at: np.ndarray) -> np.ndarray:
        return weights_of(at, self.z[at], self.n[at])

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def sample_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of (text, label), drawn by hash of the text so that copies come together and then count once."""
    total = rows.count()
    share = min(1.0, max_rows / max(1, total))
    picked = rows.withColumn("key", F.xxhash64("text"))
    picked = picked.where(F.pmod(F.col("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.groupBy("key", "label").agg(F.first("text").alias("text"))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, passes: int = PASSES) -> dict[int, float]:
    """Weights by coordinate (``1 << BITS``: bias) from rows of (text, label 0/1); only those that are not zero."""
    context = rows.sparkSession.sparkContext
    labelled = rows.where(F.col("label").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    sample = sample_rows(labelled, max_rows).withColumn("part", F.pmod(F.col("key"), F.lit(PARTS)).cast("int"))
    # Dealt once: every pass finds the rows of a part together in one partition, and few parts share one.
    sample = sample.repartition(4 * PARTS, "part").persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, sample.select("part").distinct().count())
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for turn in range(passes):
        # The state is bounded by the number of coordinates; only blocks that the parts changed come back, averaged in Spark
        # and added where they belong, one partition after the other: the driver holds the state once and little beside it.
        state = context.broadcast((z, n) if turn else None)
        moved = sample.mapInArrow(_trainer(turn, state), f"part int, {MOVED}")
        for mean in moved.groupBy("block").applyInArrow(_mean(parts), MOVED).toLocalIterator():
            at = slice(mean["block"] * BLOCK, (mean["block"] + 1) * BLOCK)
            z[at] += np.frombuffer(mean["z"])
            n[at] += np.frombuffer(mean["n"])
        state.destroy()
    sample.unpersist()
    weights: dict[int, float] = {}
    for first in range(0, len(n), BLOCK):
        at = first + np.flatnonzero(n[first : first + BLOCK])
        w = weights_of(at, z[at], n[at])
        weights.update(zip(at[w != 0].tolist(), w[w != 0].tolist()))
    return weights


def _trainer(turn: int, state):
    """One pass over the parts of a partition, each from the shared state and in an order that changes with the pass; the changes they make, by block."""

    def train(rows: pa.Table, part: int) -> pa.RecordBatch:
        order = np.argsort(mix(rows["key"].to_numpy().view(np.uint64) + np.uint64(turn)), kind="stable")
        rows = rows.take(pa.array(order))
        before = state.value or (None, None)
        model = Ftrl(*before)
        label = rows["label"].to_numpy()
        row = 0
        for count, slots, begin in text_features(rows["text"].combine_chunks()):
            for i in range(count):
                own = np.append(slots[begin[i] : begin[i + 1]], 1 << BITS)
                model.learn(own, int(label[row]))
                row += 1
        # What changed is found block by block, beside one copy of the state.
        moved, z, n = [], [], []
        for k in range(-(-len(model.n) // BLOCK)):
            at = slice(k * BLOCK, (k + 1) * BLOCK)
            dz, dn = (x[at] if old is None else x[at] - old[at] for x, old in zip((model.z, model.n), before))
            if dz.any() or dn.any():
                moved.append(k), z.append(dz.tobytes()), n.append(dn.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(moved), pa.int32()), pa.array(moved, pa.int32()), pa.array(z, pa.binary()), pa.array(n, pa.binary())],
            names=["part", "block", "z", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            part = table["part"].to_numpy()
            for own in np.unique(part):
                yield train(table.filter(pa.array(part == own)), int(own))

    return run


def _mean(parts: int):
    """The mean over all parts of the changes to a block; a part without a row did not change it."""

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        sums = [sum(np.frombuffer(x.as_buffer()) for x in rows[c]) / parts for c in ("z", "n")]
        return pa.table({"block": rows["block"].slice(0, 1), "z": pa.array([sums[0].tobytes()], pa.binary()), "n": pa.array([sums[1].tobytes()], pa.binary())})

    return mean


def score(docs: DataFrame, weights: dict[int, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, in place of a column of that name if there is one."""
    weights = weights or {1 << BITS: -1e3}
    sent = docs.sparkSession.sparkContext.broadcast((np.array([*weights.keys()], np.int64), np.array([*weights.values()], float)))
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "score")).alias("row"), F.col(f"`{text}`").alias("text"))
    fields = f"row {docs.schema['row'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = w
        for batch in batches:
            out = []
            for n, slots, begin in text_features(column(batch, "text")):
                # Each text's weights are summed by themselves: equal texts score the same wherever they stand.
                sums, some = np.zeros(n), begin[1:] > begin[:-1]
                if some.any():
                    sums[some] = np.add.reduceat(table[slots], begin[:-1][some])
                out.append(sums + table[1 << BITS])
            scores = sigmoid(np.concatenate(out)) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return docs.mapInArrow(run, fields).select("row.*", "score")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold (remainder 0)."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("label")).distinct()
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")).select("text", "label")
