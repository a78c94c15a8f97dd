"""Spelling variants against a comparison of all words with all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from tickloom.llm import queries, spelling
from tickloom.llm.spelling import count_words, runs, variant_groups


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n: dict[str, int], least=5, ratio=5):
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= ratio * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def slow_count(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return out


def test_variants_of_random_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abcé÷", k=rng.randint(6, 8))) for _ in range(600)}
    n = {w: rng.choice([1, 4, 5, 6, 30, 150, 900]) for w in words}
    frame = spark.createDataFrame([(w, c, "clash") for w, c in n.items()], "word string, n long, near string")
    got = {tuple(r) for r in variant_groups(frame).collect()}
    assert got == brute(n) and any(form for _, form, *_ in got)


def test_chains_hubs_and_long_words(spark):
    n = {"abcdef" + "x" * k: 5**(k + 1) for k in range(6)} | {"hubbed" + chr(97 + i): 5 for i in range(26)} | {"hubbed": 1000, "z" * 3000: 50, "z" * 3001: 9}
    got = {tuple(r) for r in variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute(n)
    assert max(row[4] for row in got) == 26


def test_counts(spark):
    text = "Ábcdefg ABCDEFG abcdefg÷x×y naïveté can't don't " * 3 + "École ÉCOLE"
    rng = random.Random(8)
    docs = [(k, " ".join("".join(rng.choices("abcdEFé", k=rng.randint(1, 12))) for _ in range(400))) for k in range(20)]
    docs += [(100, text), (100, text), (101, ""), (102, None), (103, "w" * 70_000 + " tail tailing")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in count_words(frame).collect()}
    assert got == dict(slow_count(docs))


def test_pieces_cut_between_words():
    text = "Alpha béta-gamma  delta" * 50
    want = [w for part in runs(text) for w in part]
    assert [w for part in runs(text, 7) for w in part] == want and "béta" in want
    assert list(runs("")) == []


def test_empty_table(spark):
    assert variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_of_a_small_table(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=rng.randint(5, 9))) for _ in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=300))) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.QUERIES["op13_spelling_variants"][0](spark, str(tmp_path)).collect()}
    assert got == brute(slow_count(docs)) and any(row[1] for row in got)
    assert spelling.SLIP == 199
