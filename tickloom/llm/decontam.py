"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one
window). Containment needs every word of the window, so its rarest shingle is a
necessary prefix: shingles are ordered by their frequency over all documents, the
rarest of each window is its prefix token, and documents join windows on it.
The position of the shingle in window and document bounds where the window can
lie, and its length must fit; what is left is verified word by word.

Which positions of a document are worth joining is decided by a bitmap of fixed
size over the shingles, so nothing that is sent to the executors grows with the
benchmark; the join itself is a shuffle.

Defined results: a null or wordless text has no words, no hits and no items; a
null or wordless item has no windows; items are told apart by item_id, rows that
repeat one are one item; rows that repeat a doc_id are documents of their own.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.skew import lookup
from tickloom.llm.store import stored
from tickloom.llm.words import PLAIN_WORD, column, hash_spans, mix, pieces, words_of

WIDTH = 13
SHINGLE = 4
BITMAP_BITS = 24


class Bitmap:
    """A fixed-size filter over 64-bit hashes: no false negatives."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    @classmethod
    def of(cls, keys: DataFrame) -> Bitmap:
        """Built from distinct slots: at most 2 ** BITMAP_BITS of them, packed by the tasks."""
        slot = F.shiftrightunsigned(F.col("shingle"), 64 - BITMAP_BITS)
        packed = keys.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, cast(slot & 63 AS int)) AS bit")
        packed = packed.groupBy("word").agg(F.bit_or("bit").alias("bit"))
        words = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
        found = packed.toArrow()  # at most one row a word of the bitmap, in one job however many partitions there are
        words[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = self.slots(hashes)
        return (self.bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


def _shingle_hashes(h: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it lies in one text) of the ``size`` words from each word on."""
    n = len(h)
    total = np.zeros(n, np.uint64) + np.uint64(size)
    for k in range(min(size, n)):
        total[: n - k] = mix(total[: n - k] ^ h[k:])
    last = np.repeat(firsts[1:], np.diff(firsts))
    return total, last - np.arange(n) >= size


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def windows_of(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """``item_id, words`` (array of strings): the distinct windows of every item."""
    # Lower-casing A-Z only: other letters stay as they are.
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.col(item_id).alias("item_id"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, width))).alias("words")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """``words, shingle, at, size``: every shingle of every distinct window; a window of fewer words than a shingle is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([" ".join(w.as_py()) for w in batch.column(0)], pa.string())
            row, shingle, at, size = [], [], [], []
            for piece in pieces(texts):
                low, starts, ends, firsts = words_of(piece, PLAIN_WORD)
                h = hash_spans(low, starts, ends)
                for i in range(piece.n):
                    own = h[firsts[i] : firsts[i + 1]]
                    k = min(SHINGLE, len(own))
                    value, good = _shingle_hashes(own, np.array([0, len(own)]), k)
                    for j in np.flatnonzero(good):
                        row.append(piece.first + i), shingle.append(value[j]), at.append(int(j)), size.append(k)
            words = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(signed(np.array(shingle, np.uint64))), pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                names=["words", "shingle", "at", "size"],
            )

    return windows.select("words").distinct().mapInArrow(run, "words array<string>, shingle long, at int, size int")


def document_frequency(docs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """``shingle, n``: how often shingles that pass the bitmap occur over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bitmap(bitmap.value)
        for batch in batches:
            found = []
            for piece in pieces(column(batch, "_text")):
                low, starts, ends, firsts = words_of(piece, PLAIN_WORD)
                h = hash_spans(low, starts, ends)
                for size in sizes:
                    value, good = _shingle_hashes(h, firsts, size)
                    found.append(value[good & filter_.has(value)])
            values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    return docs.select("_text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


SPOTS = "n_words long, spots array<struct<shingle: long, at: long, left: array<string>, right: array<string>>>"
_SPOTS = pa.list_(
    pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
)


def document_spots(docs: DataFrame, bitmap, sizes: list[int], width: int) -> DataFrame:
    """Each document with its number of words and, at every shingle that passes the bitmap, the words around it."""
    kept = [f for f in docs.schema if f.name not in ("_row", "_text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bitmap(bitmap.value)
        for batch in batches:
            n_words, spots = [], []
            for piece in pieces(column(batch, "_text")):
                low, starts, ends, firsts = words_of(piece, PLAIN_WORD)
                n_words.extend(np.diff(firsts).tolist())
                own: list[list] = [[] for _ in range(piece.n)]
                h = hash_spans(low, starts, ends)
                for size in sizes:
                    value, good = _shingle_hashes(h, firsts, size)
                    hits = np.flatnonzero(good & filter_.has(value))
                    doc = np.searchsorted(firsts, hits, side="right") - 1
                    # A window shorter than a shingle is nothing but its one shingle.
                    back, on = (width - size, width) if size == SHINGLE else (0, size)
                    for j, i, v in zip(hits.tolist(), doc.tolist(), signed(value[hits]).tolist(), strict=True):
                        begin, end = max(int(firsts[i]), j - back), min(int(firsts[i + 1]), j + on)
                        around = [low[a:b].tobytes().decode() for a, b in zip(starts[begin:end], ends[begin:end], strict=True)]
                        own[i].append({"shingle": v, "at": j - int(firsts[i]), "left": around[: j - begin], "right": around[j - begin :]})
                spots.extend(own)
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, f.name) for f in kept), column(batch, "_row"), pa.array(n_words, pa.int64()), pa.array(spots, _SPOTS)],
                names=[*(f.name for f in kept), "_row", "n_words", "spots"],
            )

    return docs.mapInArrow(run, f"{fields}, _row long, {SPOTS}")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    share: int = 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the ``keep`` columns."""
    spark = docs.sparkSession
    windows = stored(windows_of(items, item_id, item_text, width), "windows")
    shingled = stored(window_shingles(windows), "window-shingles")
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect())
    everything = spark.sparkContext.broadcast(Bitmap.of(shingled).bits)
    # Row numbers need to be fixed only from here on: the result is stored below.
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row")
    )
    counts = document_frequency(rows, everything, sizes)
    order = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "shingle", "at")
    prefixes = shingled.join(counts, "shingle", "left").where(F.col("n") > 0)
    # A shingle that no document has rules its window out.
    complete = shingled.groupBy("words").agg(F.count("*").alias("all")).join(
        prefixes.groupBy("words").agg(F.count("*").alias("present")), "words"
    ).where(F.col("all") == F.col("present"))
    prefixes = prefixes.join(complete.select("words"), "words", "left_semi")
    prefixes = stored(prefixes.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("shingle", "words", "at"), "prefixes")
    rare = spark.sparkContext.broadcast(Bitmap.of(prefixes.select("shingle")).bits)
    found = stored(document_spots(rows, rare, sizes, width), "spots")
    spots = found.where(F.size("spots") > 0).select("_row", F.explode("spots").alias("s")).select("_row", "s.*")
    by_shingle = prefixes.groupBy("shingle").agg(F.collect_list(F.struct("words", F.col("at").alias("w_at"))).alias("ws"))
    joined = lookup(spots, by_shingle, "shingle", F.struct("_row", "at")).select("_row", "at", "left", "right", F.explode("ws").alias("w"))
    # Positional and length bounds, then every word.
    offset, size = F.col("w.w_at"), F.size("w.words")
    fits = (F.size("left") >= offset) & (F.size("right") >= size - offset)
    around = F.concat(F.slice("left", F.size("left") - offset + 1, offset), F.slice("right", F.lit(1), size - offset))
    hits = (
        joined.where(fits)
        .where(around == F.col("w.words"))
        .select("_row", (F.col("at") - offset).alias("start"), size.alias("size"), F.col("w.words").alias("words"))
    )
    hits = stored(hits, "hits")
    reach = Window.partitionBy("_row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(reach), F.lit(0))))
    covered = hits.select("_row", "start", "size").distinct().withColumn("fresh", fresh).groupBy("_row").agg(F.sum("fresh").alias("n_hit"))
    owners = windows.select("words", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = (
        hits.select("_row", "words").distinct().join(owners, "words").select("_row", "item_id").distinct()
        .groupBy("_row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    facts = found.select("_row", "doc_id", *keep, "n_words").join(covered, "_row", "left").join(listed, "_row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_col = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return facts.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *keep,
    )
