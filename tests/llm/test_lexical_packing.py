"""Lexical packing: pieces hold the library's ids once, windows are full, neighbours are those BM25 ranks first."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm.lexical_packing import B, K1, Index, fill_windows, in_powers, pack_related

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_scores_equal_the_formula():
    rng = random.Random(2)
    parts = [np.array(rng.choices(range(40), k=rng.randint(1, 60)), np.uint16) for _ in range(50)]
    df = Counter(t for p in parts for t in set(p.tolist()))
    idf = np.array([math.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0.0 for t in range(40)])
    mean = sum(map(len, parts)) / 50
    index = Index(parts, idf, mean, 6)
    for seed in range(50):
        tf = Counter(parts[seed].tolist())
        query = sorted(tf, key=lambda t: (-idf[t] * tf[t], t))[:6]
        want = [
            sum(idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(p) / mean)) for t, c in Counter(p.tolist()).items() if t in query) for p in parts
        ]
        np.testing.assert_allclose(index.scores(seed), want, atol=1e-12)


def test_windows_take_the_best_unused_neighbours():
    rng = random.Random(3)
    parts = [np.array(rng.choices(range(20 * (k % 5), 20 * (k % 5) + 20), k=rng.randint(1, 90)), np.uint16) for k in range(60)]
    index = Index(parts, np.ones(100), 40.0, 10)
    sizes, capacity = [len(p) for p in parts], 128
    pieces = list(fill_windows(sizes, index, capacity))
    held = Counter()
    for doc, start, length, _, _ in pieces:
        assert start == held[doc]
        held[doc] += length
    assert [held[k] for k in range(60)] == sizes
    # Replay: within a window, whole documents follow the seed in the order of their scores.
    windows = defaultdict(list)
    for piece in pieces:
        windows[piece[3]].append(piece)
    used = set()
    for w, inside in windows.items():
        seed = inside[0][0]
        used.add(seed)
        for doc, *_ in inside[1:]:
            scores = index.scores(seed)
            left = [k for k in range(60) if k not in used]
            assert doc == min(left, key=lambda k: (-scores[k], k))
            used.add(doc)
        assert sum(p[2] for p in inside) == capacity or w == max(windows)
    # Topics stay together: most neighbours share their seed's.
    shared = [p[0] % 5 == inside[0][0] % 5 for inside in windows.values() for p in inside[1:]]
    assert sum(shared) > 0.6 * len(shared)


def test_short_windows_become_powers_of_two():
    pieces = [(0, 3, 50, 7, 0), (1, 0, 30, 7, 50), (2, 5, 5, 7, 80)]
    out = list(in_powers(pieces, 128))
    sizes = Counter()
    for _, _, length, window, offset in out:
        assert offset == sizes[window]
        sizes[window] += length
    assert sorted(sizes.values()) == [1, 4, 16, 64] and min(sizes) == 7
    assert list(in_powers([], 128)) == []


@pytest.mark.parametrize("shard_tokens", [1 << 20, 500])
def test_pieces_hold_every_id_once(spark, shard_tokens):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "naïve", "一二", "<|endoftext|>", "x1"], k=rng.randint(0, 300))) for _ in range(60)]
    texts += ["", None, "y " * 200_000, "same text", "same text"]
    ids = [*range(len(texts) - 2), 7, None]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], "doc_id long, text string, start string, row int")
    out = pack_related(docs, PATH, capacity=128, end_id=1, with_ids=True, shard_tokens=shard_tokens).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in zip(ids, texts))
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        windows[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for doc_id in set(ids) - {7, None}:
        parts = sorted(pieces[doc_id], key=lambda r: r["start"])
        together = [x for r in parts for x in r["ids"]]
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        assert want[(doc_id, tuple(together))] == 1 and all(r["doc_tokens"] == len(together) for r in parts)
    assert sum(r["length"] for r in out) == sum(len(k[1]) * n for k, n in want.items())
    for inside in windows.values():
        inside.sort(key=lambda r: r["offset"])
        sizes = [r["length"] for r in inside]
        assert [r["offset"] for r in inside] == [0, *np.cumsum(sizes)[:-1].tolist()]
        total = sum(sizes)
        assert total == 128 or total & (total - 1) == 0


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_related(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="offset"):
        pack_related(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, offset int"), PATH, keep=("doc_id", "offset"))
