"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words at most one edit apart, the shorter one (of equal lengths: the smaller) gives two disjoint chunks, its halves. One
edit spoils one half at most, so the other half is a positional gram of the longer word, moved by one place at
most: the first half stands where it stood, the second is moved by the difference in length. The
longer word gives its grams of these lengths and places, for partners of its own length and of one
less. Chunks meet grams in a join; the edit distance is verified within it, so only near pairs come out.
A pair whose first halves agree does not count again for its second halves.

Defined results: null and empty texts have no words; equal words of all documents are one; a text is read in
pieces between words, however long it is. Ties of the form go to the smallest word in code-point order. Forms
have at least ``ratio`` times the word's count, so chains of forms end. Columns other than the two named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.skew import lookup
from tickloom.llm.store import stored

RUN = re.compile("[a-zÀ-ÿ]+")
EDGE = re.compile("[^a-zÀ-ÿ]")
PIECE = 1 << 20
HELD = 200_000  # words a task sums before it gives them out
SLIP = 199


def runs(text: str, piece: int = PIECE) -> Iterator[list[str]]:
    """The lower-cased runs of a text, piece by piece."""
    text = text.encode().lower().decode()  # bytes: A-Z only
    at = 0
    while at < len(text):
        edge = EDGE.search(text, min(at + piece, len(text)))
        end = edge.start() if edge else len(text)
        yield RUN.findall(text, at, end)
        at = end


def slipped(word: str, h: int, slip: int = SLIP) -> str:
    """The word without one code point where its hash says so."""
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, slip: int | None = SLIP) -> DataFrame:
    """``word, n`` of words of at least ``least_length`` code points; ``slip`` plants the slips of the pen (None: none)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for words in runs(value.as_py()):
                    for word, n in Counter(words).items():
                        if slip is not None and len(word) >= least_length:
                            word = slipped(word, zlib.crc32(word.encode(), start), slip)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: every pair of distinct words exactly one edit apart, once, the chunked word first."""
    size, half = F.char_length("word"), F.floor(F.char_length("word") / 2).cast("int")
    piece = lambda which, size_, text: F.struct(F.lit(which).alias("which"), size_.alias("size"), text.alias("gram"))
    cut = lambda start, length: F.substring(F.col("word"), start, length)
    chunks = F.explode(F.array(piece(1, size, cut(F.lit(1), half)), piece(2, size, cut(half + 1, size - half)))).alias("key")
    # Partners of the same length, and of one less: their halves, the second moved by the difference.
    less = F.floor((size - 1) / 2).cast("int")
    grams = F.explode(
        F.array(
            piece(1, size, cut(F.lit(1), half)),
            piece(2, size, cut(half + 1, size - half)),
            piece(1, size - 1, cut(F.lit(1), less)),
            piece(2, size - 1, cut(less + 2, size - 1 - less)),
        )
    ).alias("key")
    left = words.select(F.col("word").alias("a"), F.col("n").alias("na"), chunks).select("a", "na", "key.*")
    right = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), grams).select("b", "nb", "key.*")
    first = F.floor(F.col("size") / 2).cast("int")
    once = (F.col("which") == 1) | (F.substring(F.col("a"), F.lit(1), first) != F.substring(F.col("b"), F.lit(1), first))
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    return left.join(right, ["which", "size", "gram"]).where(once & ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``: forms followed to the last, twice as far each round (a form has several times the count, so few rounds)."""
    links = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        over = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = lookup(links, over, "root", F.col("word"), "left")
        moved = stored(moved.select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(counts: DataFrame, least: int = 5, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words (``word, n``) that occur ``least`` times or more."""
    words = stored(counts.where(F.col("n") >= least).select("word", "n"), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumns({"near": F.col("best.near"), "near_n": -F.col("best.rank")})
    good = F.col("near_n") >= ratio * F.col("n")
    forms = stored(
        found.select(
            "word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near_n")).alias("form_n")
        ),
        "forms",
    )
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
