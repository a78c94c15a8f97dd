"""Registered queries of the operators: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import sqltext
from tickloom.llm.store import prepare, stored

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc", sqltext.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.warc import parse_records, read_records, write_archive

    archive = write_archive(table(spark, sf_dir, "pages"), min_payload_bytes=0)
    return parse_records(read_records(spark, archive)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op3_chat", sqltext.CHAT)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.chat import format_conversations, read_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    output = stored(format_conversations(turns.unionByName(extra)), "chat")
    read = read_conversations(output)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op4_token_count")
def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, files)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query("op6_decontamination", sqltext.DECONTAMINATION)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.decontam import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, share=20)


@query("op10_minhash_dedup")
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=5, threshold=0.85)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.toxicity import fit, fold_of, score, training_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, weights).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.langid import fit, fold_of, predict, training_rows

    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs.select("doc_id", "text", "lang")))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query("op8_embedding_dedup", sqltext.EMBEDDING)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.9)


@query("op11_lexical_packing")
def op11_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.lexical_packing import pack_related

    return pack_related(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)


@query("op12_conversation_repair", sqltext.REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.repair import Repair, damaged

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(turns))
    counts, digests = repair.counts(), repair.digests()
    same = lambda right: F.col("conv_id").eqNullSafe(F.col(right))
    out = turns.select("conv_id").distinct().join(counts.withColumnRenamed("conv_id", "counted"), same("counted"), "left")
    out = out.join(digests.withColumnRenamed("conv_id", "digested"), same("digested"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


@query("op13_spelling_variants", sqltext.SPELLING)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.spelling import count_words, variant_groups

    return variant_groups(count_words(table(spark, sf_dir, "documents")))
