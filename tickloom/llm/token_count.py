"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proven beforehand with the
library. Pre-tokens among them count one without any merging; only the rest are
merged. BPE never merges across pre-tokens, so the sum is exact.

Defined results: a null or empty text has 0 bytes and 0 tokens. The ``keep``
columns come back unchanged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import word_bpe

MERGED_WORDS = 300_000  # merged words a worker remembers before it starts anew


def whole_tokens(path: str) -> list[str]:
    """The proven strings: at most one for each vocabulary entry."""
    return word_bpe(path).whole_tokens()


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """``keep`` columns with ``n_bytes, n_tokens, over_limit``."""
    proven = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(path)))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, whole, merged = word_bpe(path), proven.value, {}

        def count(s: str) -> int:
            words = bpe.words(s)
            if words is None:
                return len(bpe.plain(s))
            total = len(words)
            for w in words:
                if w not in whole:
                    n = merged.get(w)
                    if n is None:
                        n = merged[w] = len(bpe.merge([w]))
                    total += n - 1
            if len(merged) > MERGED_WORDS:
                merged.clear()
            return total

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = [count(column[i].as_py()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    counted = rows.withColumn("n_bytes", F.octet_length("_text").cast("long")).select(*keep, "n_bytes", "_text")
    out = counted.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
