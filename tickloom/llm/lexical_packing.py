"""Packing of related documents: a sharded BM25 index fills each window with unused neighbours of its seed.

Whole windows are cut off long documents as they are tokenized; the rest of each
document, shorter than a window, is what the index knows. Its terms are token ids, so
document frequencies over the whole corpus are one number for each vocabulary entry.
The rests are dealt at random over shards of about ``shard_tokens`` tokens. A task builds
the inverted index of one shard, then fills window after window: the seed is what the window before
cut off, or else the first unused rest; the unused rests follow by falling score for the
``query_terms`` best terms of the seed (tf x idf), those that share none of them last, in order. The last
one is cut where the window ends. What is left at the end of a shard is cut into powers of two, which need
no padding, so nothing is padded at all.

Defined results: a null text is empty and holds the end id alone; rows that repeat a doc_id are
documents of their own; equal scores keep the order of the rests; an empty table gives no
pieces. Columns not named in ``keep`` are ignored; a kept column must not be named like an output column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import byte_bpe
from tickloom.llm.store import stored

SHARD_TOKENS = 1 << 20
QUERY_TERMS = 24
K1, B = 1.2, 0.75
WHOLE = 1 << 62  # windows cut off one document are numbered from here
ADDED = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
PLACE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def cut_windows(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, keep: tuple[str, ...], with_ids: bool, width: int) -> DataFrame:
    """Whole windows with their sequence_id; the rest of each document (no sequence_id yet) with its ids, ``width`` bytes each."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    rows = docs.select(kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, whole, at = byte_bpe(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            row, out = [], []
            for i, value in enumerate(batch.column(1)):
                tokens = np.append(bpe.packed(value.as_py()), end_id).astype(f"<u{width}")
                for start in range(0, len(tokens), capacity):
                    ids = tokens[start : start + capacity]
                    if len(ids) == capacity:
                        place = (zlib.crc32(_bytes(ids)), WHOLE + (part << 36) + whole, 0)
                        whole += 1
                    else:
                        place = (None, None, None)
                    row.append(i)
                    out.append((start, len(ids), place[0], len(tokens), *place[1:], None if place[1] and not with_ids else ids.tobytes(), (part << 36) + at))
                    at += 1
            kept_rows = batch.column(0).take(pa.array(row, pa.int64()))
            columns = [pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.binary() if k == 6 else pa.int64()) for k in range(8)]
            yield pa.RecordBatch.from_arrays([kept_rows, *columns], names=["row", *ADDED, "serial"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {PLACE}, serial long")


def document_frequencies(rests: DataFrame, width: int) -> DataFrame:
    """``term, n``: the rests that hold each token id, summed within each task first."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            terms, _, _ = term_counts([np.frombuffer(x.as_buffer(), kind) for x in batch.column(0)])
            one = np.bincount(terms, minlength=len(counts))
            one[: len(counts)] += counts
            counts = one
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["term", "n"])

    return rests.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def term_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, how often), ordered by document and term."""
    sizes = [len(p) for p in parts]
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)
    key = (owner << np.uint64(32)) | np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.uint64)
    key.sort()
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    often = np.diff(np.append(fresh, len(key)))
    return (key[fresh] & np.uint64(0xFFFFFFFF)).astype(np.int64), (key[fresh] >> np.uint64(32)).astype(np.int64), often


class Index:
    """BM25 postings of one shard, and the best terms of each of its documents."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int):
        self.n = len(parts)
        term, doc, often = term_counts(parts)
        length = np.array([len(p) for p in parts], float)
        impact = idf[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * length[doc] / mean_length))
        weight = idf[term] * often
        order = np.lexsort((term, -weight, doc))
        first = np.searchsorted(doc, np.arange(self.n + 1))
        rank = np.arange(len(doc)) - first[doc[order]]
        best = order[rank < query_terms]
        self.query, self.query_at = term[best], np.searchsorted(doc[best], np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.terms, self.at = np.unique(term[by_term], return_index=True)
        self.at = np.append(self.at, len(term))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the best terms of one."""
        where = np.searchsorted(self.terms, self.query[self.query_at[seed] : self.query_at[seed + 1]])
        lists = [slice(self.at[k], self.at[k + 1]) for k in where]
        if not lists:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in lists]), np.concatenate([self.impact[s] for s in lists]), self.n)


def fill_windows(sizes: list[int], index: Index, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, from, how many, window, offset) of every piece; the last window may be short."""
    unused = np.ones(len(sizes), bool)
    window, room, carried, first = 0, capacity, None, 0
    while carried is not None or unused.any():
        if carried is None:
            first += int(unused[first:].argmax())
            carried = (first, 0)
            unused[first] = False
        seed = carried[0]
        queue, carried = [carried], None
        scores = None
        while room:
            if not queue:
                if scores is None:
                    scores = np.where(unused, index.scores(seed), -1.0)
                    left = int(unused.sum())
                    ranked = np.argsort(-scores, kind="stable")[:left].tolist()[::-1]
                if not ranked:
                    break
                queue = [(ranked.pop(), 0)]
                unused[queue[0][0]] = False
            doc, start = queue.pop()
            take = min(room, sizes[doc] - start)
            yield doc, start, take, window, capacity - room
            room -= take
            if start + take < sizes[doc]:
                carried = (doc, start + take)
        if not room:
            window, room = window + 1, capacity


def in_powers(pieces: list[tuple[int, int, int, int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The pieces of a short window dealt anew over windows whose sizes are powers of two, largest first."""
    total = sum(p[2] for p in pieces)
    window = pieces[0][3] if pieces else 0
    sizes = [1 << b for b in range(capacity.bit_length(), -1, -1) if total >> b & 1]
    at, room = 0, sizes[0] if sizes else 0
    for doc, start, length, _, _ in pieces:
        while length:
            take = min(length, room)
            yield doc, start, take, window, sizes[at] - room
            start, length, room = start + take, length - take, room - take
            if not room and at + 1 < len(sizes):
                at, window = at + 1, window + 1
                room = sizes[at]


def pack_related(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
    shard_tokens: int = SHARD_TOKENS,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """One row per piece: ``keep`` columns, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``."""
    if set(keep) & set(ADDED):
        raise ValueError(f"kept columns must not be named {sorted(set(keep) & set(ADDED))}")
    width = 2 if byte_bpe(path).two_bytes and end_id < 1 << 16 else 4
    spark = docs.sparkSession
    cut = stored(cut_windows(docs, path, capacity, end_id, text, keep, with_ids, width), "windows")
    rests = cut.where(F.col("sequence_id").isNull())
    n, tokens = rests.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # One number for each vocabulary entry at most.
    frequency = {r["term"]: r["n"] for r in document_frequencies(rests, width).collect()}
    idf = np.zeros(max(frequency, default=0) + 1)
    for term, count in frequency.items():
        idf[term] = np.log1p((n - count + 0.5) / (count + 0.5))
    shared, mean_length = spark.sparkContext.broadcast(idf), tokens / max(n, 1)
    shards = max(1, -(-tokens // shard_tokens))
    kind = f"<u{width}"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("serial").combine_chunks()
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table["ids"]]
        starts, totals = table["start"].to_numpy(), table["doc_tokens"].to_numpy()
        base = table["shard"][0].as_py() << 36
        index = Index(parts, shared.value, mean_length, query_terms)
        placed = list(fill_windows([len(p) for p in parts], index, capacity))
        # Only the last window may be short.
        short = next((k for k in range(len(placed)) if placed[k][3] == placed[-1][3]), 0)
        if sum(p[2] for p in placed[short:]) < capacity:
            placed = placed[:short] + list(in_powers(placed[short:], capacity))
        row, out = [], []
        for doc, start, length, window, offset in placed:
            ids = parts[doc][start : start + length]
            row.append(doc)
            out.append((int(starts[doc]) + start, length, zlib.crc32(_bytes(ids)), int(totals[doc]), base + window, offset, ids.tobytes() if with_ids else None))
        columns = [pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
        return pa.table([table["row"].take(pa.array(row, pa.int64())), *columns], names=["row", *ADDED])

    dealt = rests.select("row", "start", "length", "doc_tokens", "ids", "serial", F.pmod(F.xxhash64("serial"), F.lit(shards)).alias("shard"))
    packed = dealt.groupBy("shard").applyInArrow(pack, f"row {cut.schema['row'].dataType.simpleString()}, {PLACE}")
    pieces = packed.unionByName(cut.where(F.col("sequence_id").isNotNull()).drop("serial"))
    out = pieces.select("row.*", *(c for c in ADDED if c != "ids"), *(["ids"] if with_ids else []))
    if not with_ids:
        return out
    digits = ", ".join(f"hex(substring(ids, {width} * cast(k as int) + {j}, 1))" for j in range(width, 0, -1))
    one = f"conv(concat({digits}), 16, 10)"
    return out.withColumn("ids", F.expr(f"transform(sequence(0L, length - 1), k -> cast({one} as int))"))
