"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over the whole corpus, so the common
ones take one byte. Two bits per id in separate control bytes say how many bytes
(1 to 4) it has; a table over all control bytes gives the four lengths, and numpy
gathers the values. A file set has ``blocks`` (ascending document order) and
``ranks`` (rank -> id, one row for each id that occurs).

Defined results: a null text is empty; an empty document holds the end id alone;
a null doc_id comes first; rows that share a doc_id are ordered by the hash of
their ids, then the ids. An empty table gives no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.bpe import word_bpe
from tickloom.llm.store import shared_folder, stored

BLOCK_IDS = 1 << 18
SHARD_IDS = 8 << 20
# Lengths of the four values behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    extra = (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(extra + 1) - (extra + 1)
    data = np.zeros(int((extra + 1).sum()), np.uint8)
    for k in range(4):
        rows = extra >= k
        data[at[rows] + k] = (v[rows] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in range(1, 4):
        out |= np.where(lengths > k, raw[at + k] << np.uint32(8 * k), 0).astype(np.uint32)
    return out


@dataclass(frozen=True)
class TokenFiles:
    blocks: str
    ranks: str


BLOCK_SCHEMA = "shard int, block int, before long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Tokenize each text once, rank the ids over all documents, write blocks in document order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    # Two bytes an id until ranks are known, where the vocabulary allows.
    kind = "<u2" if word_bpe(path).two_bytes and end_id < 1 << 16 else "<u4"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            column = batch.column(1)
            ids = [bpe.packed(column[i].as_py()).astype(kind).tobytes() + end for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    encoded = stored(rows.mapInArrow(tokenize, "doc_id long, ids binary"), "token-ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for part in id_parts(batch.column(0), kind):
                one = np.bincount(part, minlength=len(counts))
                one[: len(counts)] += counts
                counts = one
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row for each vocabulary entry at most.
    table = sorted(((r["id"], r["n"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    by_rank = np.array([i for i, _ in table], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    total = sum(n for _, n in table)
    files = TokenFiles(shared_folder(spark, "token-blocks"), shared_folder(spark, "token-ranks"))
    ranked = [(int(k), int(i)) for k, i in enumerate(by_rank)]
    spark.createDataFrame(ranked, "rank long, id long").coalesce(1).write.parquet(files.ranks)
    shared_ranks = spark.sparkContext.broadcast(rank_of)

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ranks = TaskContext.get().partitionId(), shared_ranks.value
        ids, parts, held, block, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(parts)
            control, data = encode_ids(ranks[values])
            lengths = [len(p) for p in parts]
            row = {
                "shard": shard, "block": block, "before": before, "n": len(values),
                "doc_ids": list(ids), "lengths": lengths, "control": control, "data": data,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCK)

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                parts.append(np.frombuffer(batch.column(1)[i].as_buffer(), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    ids, parts, block, before, held = [], [], block + 1, before + held, 0
        if parts:
            yield flush()

    key = F.xxhash64("ids")
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_IDS))
    ordered = (
        encoded.withColumn("key", key)
        .repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), F.col("key").asc())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key", "ids")
    )
    ordered.select("doc_id", "ids").mapInArrow(block_up, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(files.blocks)
    return files


def id_parts(column: pa.Array, kind: str, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """All ids of a batch in pieces of bounded size, whichever documents they belong to."""
    _, offsets, data = column.buffers()
    if len(column) and data is not None:
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)
        for at in range(0, len(ids), most):
            yield ids[at : at + most]


_ARROW_BLOCK = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
    ]
)


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(files.blocks)
    ranks = spark.read.schema("rank long, id long").parquet(files.ranks)
    # Bounded by the vocabulary.
    id_of = np.zeros(max(1, ranks.count()), np.uint32)
    for r in ranks.collect():
        id_of[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast(id_of)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard: thousands of blocks each.
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                first, n, lengths, control, data = (batch.column(k)[row].as_py() for k in (0, 1, 3, 4, 5))
                ids = table[decode_ids(control, data, n)].astype("<u4")
                lengths = np.array(lengths, np.int64)
                start = first + np.cumsum(lengths) - lengths
                cut = np.split(ids, np.cumsum(lengths)[:-1])
                crc = [zlib.crc32(x.tobytes()) for x in cut]
                out = [batch.column(2)[row].values, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([x.astype(np.int64) for x in cut], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    placed = blocks.join(base, "shard").select((F.col("base") + F.col("before")).alias("first"), "n", "doc_ids", "lengths", "control", "data")
    extra = ", ids array<long>" if with_ids else ""
    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")
