"""From raw documents to packed training sequences: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir), returns a DataFrame and is written as Parquet
before the next one reads it. All but the last return the columns of ``docs``, whatever they are
called; rows that repeat are rows of their own until the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.store import prepare, stored

CLEAR_SHARE = 0.4  # a text is kept if one language holds this share of its letters


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no column an operator adds can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity model scores 0.5 or more go."""
    from tickloom.llm.toxicity import fit, score, training_rows

    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit(training_rows(docs.select("doc_id", "text"), labels))
    return score(_boxed(docs), weights).where(F.col("score") < 0.5).select("row.*")


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those in which no language has ``CLEAR_SHARE`` of the letters."""
    from tickloom.llm.langid import UNKNOWN, fit, predict, training_rows

    prepare(spark)
    model = fit(training_rows(docs.select("doc_id", "text", "lang")))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(_boxed(docs), model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= CLEAR_SHARE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8 or more."""
    from tickloom.llm.minhash_dedup import without_near_duplicates

    prepare(spark)
    return without_near_duplicates(docs, width=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark words go."""
    from tickloom.llm.decontam import find_contamination

    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    return find_contamination(boxed, items, keep=("row",)).where(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    from tickloom.llm.packing import pack_documents

    prepare(spark)
    return pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unclear_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # models, minwise tokens and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
