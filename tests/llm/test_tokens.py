"""Token ids, counts, files and packing against the library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm.bpe import byte_bpe, word_bpe
from tickloom.llm.packing import Slots, configurations, pack_documents
from tickloom.llm.token_count import count_tokens
from tickloom.llm.token_files import decode_ids, encode_ids, read_token_files, write_token_files

WORD, BYTE = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "don't 'stop 'll'S ''s 12³", "<|endoftext|> a <|startoftext|>", "a" * 3000, "!" * 900, " " * 2000 + "x", "Ünïcödé ΑΣ İstanbul ｆｕｌｌ ½ 一二 🙂", "x y z\x0b\x1c", "é ßÄ", "\n\n \t a\n b  c\r\n"]


def fuzz() -> list[str]:
    rng = random.Random(5)
    common = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x100), 9, 10, 13)] + list("   eeetttaaa''''\n")
    rare = [chr(c) for c in (0xA0, 0xB2, 0xAA, 0x130, 0x3A3, 0x5D0, 0x661, 0x4E00, 0x1F600, 0x301, 0x2028)]
    texts = ["".join(rng.choices(common, k=rng.randint(0, 60))) for _ in range(3000)]
    return texts + ["".join(rng.choices(common + rare * 4, k=rng.randint(0, 60))) for _ in range(1000)] + ODD


@pytest.mark.parametrize("path, make", [(WORD, word_bpe), (BYTE, byte_bpe)])
def test_ids_equal_the_library(path, make):
    library, fast = Tokenizer.from_file(path), make(path)
    for text in fuzz():
        assert fast.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_tokens_are_single(spark):
    library, whole = Tokenizer.from_file(WORD), word_bpe(WORD).whole_tokens()
    assert len(whole) > 10_000 and "the" in whole
    for text in whole[::500]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def rows(spark):
    texts = [*ODD, None, "The quick brown fox", "The quick brown fox"]
    ids = [*range(len(ODD)), None, 7, 7]
    return [*zip(ids, texts)], spark.createDataFrame([(i, t, "clash", 1.0) for i, t in zip(ids, texts)], "doc_id long, text string, ids string, n_tokens double")


def test_counts_of_odd_texts(spark):
    data, docs = rows(spark)
    library = Tokenizer.from_file(WORD)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, WORD, limit=100).collect())
    assert got == want
    assert count_tokens(docs.limit(0), WORD).count() == 0


def test_variable_length_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
        assert decode_ids(*encode_ids(v), n).tolist() == v.tolist()


def test_token_files_read_back(spark):
    data, docs = rows(spark)
    library = Tokenizer.from_file(WORD)
    got = read_token_files(spark, write_token_files(docs, WORD, end_id=2), with_ids=True).collect()
    got = sorted(got, key=lambda r: r["start"])
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in data)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in data), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert read_token_files(spark, write_token_files(docs.limit(0), WORD, end_id=2)).count() == 0


def test_configurations_hold_every_piece_once():
    rng = np.random.default_rng(2)
    for _ in range(5):
        histogram = {int(x): int(n) for x, n in zip(rng.integers(1, 101, 40), rng.integers(1, 60, 40))}
        configs = configurations(histogram, 100, rounds=60)
        used: Counter = Counter()
        for config, times in configs:
            assert sum(x * a for x, a in config.items()) <= 100
            for x, a in config.items():
                used[x] += a * times
        assert used == Counter(histogram)
        slots = Slots(configs)
        assert slots.sequences <= 1.1 * -(-sum(x * n for x, n in histogram.items()) // 100) + max(histogram.values())
    assert configurations({}, 100) == []


def test_packing_is_gapless_and_tight(spark):
    data, docs = rows(spark)
    library = Tokenizer.from_file(BYTE)
    got = pack_documents(docs, BYTE, capacity=64, end_id=0, keep=("doc_id",), with_ids=True).collect()
    want: Counter = Counter()
    for i, t in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first, at, k = len(ids) % 64 or 64, 0, 0
        while at < len(ids):
            size = first if k == 0 else 64
            want[i, k, at, tuple(ids[at : at + size])] += 1
            at, k = at + size, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert pack_documents(docs.limit(0), BYTE).count() == 0
