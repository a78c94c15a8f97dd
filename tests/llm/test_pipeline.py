"""The stages one by one on a small corpus with awkward rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from tickloom.llm.decontam import find_contamination
from tickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _text string"


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 20)
    rng = random.Random(1)
    filler = " ".join(rng.choice(real[0][1].split()) for _ in range(80))
    odd = [(9001, None, "en"), (9002, "", None), (9003, "12 34 !!", "en"), (9004, f"{filler} {item}", "en"), (None, filler, None), (9005, filler, "fr"), (9005, filler, "fr")]
    return spark.createDataFrame([(*r, None, 0, 0.5, "clash", "clash") for r in real + odd], EXTRA)


def test_every_stage_keeps_columns_and_clean_rows(spark, docs):
    rows = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns, name
        assert 0.5 * before <= rows.count() <= before, name
    ids = [r["doc_id"] for r in rows.select("doc_id").collect()]
    assert not {9001, 9002, 9003, 9004} & set(ids)
    # Three copies: the one with a smallest id stays.
    assert ids.count(9005) == 1 and None not in ids
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert find_contamination(rows, items).where("contaminated").isEmpty()
    name, pack = pipeline.STAGES[-1]
    pieces = pack(spark, rows, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)


def test_empty_documents_pass_through(spark, docs):
    rows = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns and rows.count() == 0, name
    assert pipeline.STAGES[-1][1](spark, rows, SF).count() == 0


def test_queries_are_the_ten(spark):
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language", "minhash_dedup", "decontamination", "packing"]
