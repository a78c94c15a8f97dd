"""Joins against brute force, with nulls, ties, copies, repeated ids and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.decontam import Bitmap, find_contamination
from tickloom.llm import embed_dedup
from tickloom.llm.embed_dedup import near_vectors
from tickloom.llm.graph import components
from tickloom.llm import minhash_dedup
from tickloom.llm.minhash_dedup import near_duplicates, without_near_duplicates
from tickloom.llm.skew import lookup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def test_byte_words_equal_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aZ9é一. \n\x0b\x00-'", k=rng.randint(0, 40))) for _ in range(500)] + ["", None, "w" * 1000]
    for kind, pattern in ((words.PLAIN_WORD, PLAIN), (words.SOLID_WORD, SOLID)):
        hashes: dict = {}
        for piece in words.pieces(pa.array(texts, pa.string()), 300):
            low, starts, ends, firsts = words.words_of(piece, kind)
            h = words.hash_spans(low, starts, ends)
            for i in range(piece.n):
                own = [low[a:b].tobytes().decode() for a, b in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]])]
                assert own == pattern.findall((texts[piece.first + i] or "").translate(LOWER))
                for w, x in zip(own, h[firsts[i] : firsts[i + 1]]):
                    assert hashes.setdefault(w, x) == x
        assert len(set(hashes.values())) == len(hashes)


def test_lookup_of_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1100, None).otherwise(F.col("id") % 500).cast("long").alias("k"), "id")
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))
        assert sorted(map(str, lookup(left, right, "k", F.col("id"), how).select("id", "k", "v").collect())) == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(160, 159), (161, 160)]
    edges = spark.createDataFrame([*chain, *star, (200, 200), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 162)}
    assert components(edges.limit(0)).count() == 0


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "a", "b", "cé", "d1", "zz", "Q"]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, sentence(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(30)]
    items += [(30, None), (31, "..."), (32, items[0][1]), (33, items[5][1]), (33, items[5][1]), (None, sentence(20))]
    docs = [(i, sentence(rng.randint(0, 60)) + "; " + rng.choice(items[:30])[1].upper() + "! " + sentence(rng.randint(0, 200))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "?!"), (63, "the"), (63, "other words"), (None, items[7][1]), (64, "x " * 30_000 + (items[3][1] or ""))]
    windows: dict = {}
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for i, t in docs:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= {str(x) for x in windows[key] if x is not None}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    frame = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, words string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(str, map(tuple, find_contamination(frame, bench).collect()))) == sorted(map(str, want))
    assert find_contamination(frame.limit(0), bench).count() == 0
    assert find_contamination(frame, bench.limit(0)).where("contaminated OR n_items > 0").count() == 0


def families() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randint(0, 5000))
    shared = [word() for _ in range(60)]
    docs = []
    for f in range(12):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 8, 150 if f == 0 else 3])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            docs.append(" ".join(text))
    docs += [" ".join(shared + [word() for _ in range(100)]) for _ in range(150)]  # one passage in many
    docs += [docs[0]] * 30 + ["one two", "One  two", "one two three four five", "", None, " \n"]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


def test_near_duplicates_equal_brute_force(spark):
    docs = families()

    def shingle_set(t):
        w = SOLID.findall((t or "").translate(LOWER))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(docs))}
    frame = spark.createDataFrame([(*d, "clash", None) for d in docs], "doc_id long, text string, cls string, n int").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame, threshold=0.85).collect()}
    assert got == want
    kept = without_near_duplicates(frame, threshold=0.85)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_repeated_and_missing_ids_keep_one_row(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (5, "quite another text of more than five words"), (None, "a b c d e f g"), (None, "a b c d e f g"), (9, ""), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, map(tuple, without_near_duplicates(frame).collect())))
    assert kept == sorted(map(str, [(5, text), rows[3], rows[4], (9, ""), (9, "")]))
    ids = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_duplicates(frame).collect())
    assert ids == sorted([("None", "5"), ("5", "5"), ("5", "5"), ("5", "5"), ("None", "None"), ("None", "None"), ("9", "9"), ("9", "9")])
    assert near_duplicates(frame.limit(0)).count() == 0 and without_near_duplicates(frame.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base, base[0] + 0.1 * rng.normal(size=(300, 16)), np.repeat(base[1:2], 200, 0), base[2:30] + 0.3 * rng.normal(size=(28, 16))])
    good = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0] * 3), (None, [0.0] * 16)]
    tiny = [(2000, [1e-200 * x for x in good[0][1]]), (2001, [1e200 * x for x in good[0][1]])]
    rows = good + bad + tiny
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    unit = np.concatenate([unit, unit[:1], unit[:1]])
    ids = [i for i, _ in good] + [2000, 2001]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    low = np.arange(len(ids))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(ids)).min(1))
        if (new == low).all():
            break
        low = new
    want = {i: (int(link[k].sum()), ids[low[k]], low[k] == k) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i, _ in bad}
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    for sigmas in (None, 5.0):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, sigmas=sigmas, cell=100).collect()}
        assert got == want
    assert near_vectors(frame.limit(0)).count() == 0
    assert {(r["n_links"], r["kept"]) for r in near_vectors(frame.where("vec_id = 1002 OR vec_id = 1000")).collect()} == {(0, True)}


def _links(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector and the lowest position in its component."""
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    low = np.arange(len(unit))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(unit)).min(1))
        if (new == low).all():
            return link.sum(1), low
        low = new


def test_wide_vectors_of_few_directions_lose_no_link(spark):
    for dim, rank in ((384, 2), (768, 3)):
        rng = np.random.default_rng(dim)
        vectors = rng.normal(size=dim) / dim**0.5 + 0.6 * rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, dim)) / dim**0.5
        degree, low = _links(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, cell=125).collect()}
        assert got == {i: (int(degree[i]), int(low[i]), low[i] == i) for i in range(len(vectors))}


def test_vectors_meet_without_a_shuffle_of_copies(spark, monkeypatch):
    """Cells of several blocks, copies, and links at the threshold, in single precision: what disks hold grows with the vectors only."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    vectors[500:600] = vectors[:100] * 2
    vectors[600:] = vectors[0] + 0.05 * rng.normal(size=(100, 8))
    vectors[:2, :] = 0
    vectors[0, :2], vectors[1, :1] = (3, 4), 1
    degree, low = _links(vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True))
    plans, kept = {}, embed_dedup.stored

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(embed_dedup, "stored", stored)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, cell=60).collect()}
    assert got == {i: (int(degree[i]), int(low[i]), low[i] == i) for i in range(len(vectors))}
    assert "Exchange" not in plans["found"] and "Generate" not in plans["found"]


def test_vectors_of_several_lengths(spark):
    """Each length is compared with its own kind, however rare it is."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for dim, n in ((2, 3), (3, 2), (5, 160), (7, 40)):
        vectors = rng.normal(size=(n, dim))
        vectors[n // 2 :] = vectors[: n - n // 2] * 3
        degree, low = _links(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        base = len(rows)
        rows += [(base + i, v) for i, v in enumerate(vectors.tolist())]
        want |= {base + i: (int(degree[i]), base + int(low[i]), low[i] == i) for i in range(n)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, cell=50).collect()}
    assert got == want


def test_a_large_group_of_near_copies_is_joined_block_by_block(spark, monkeypatch):
    """Its members meet in a number of blocks that does not grow with their square, and make one component."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "SMALL", 16)
    sizes, link_blocks = [], minhash_dedup.Join.link_blocks
    monkeypatch.setattr(minhash_dedup.Join, "link_blocks", lambda self, rows, nodes: (sizes.append((rows.count(), nodes)), link_blocks(self, rows, nodes))[1])
    monkeypatch.setattr(minhash_dedup.Join, "link_to_one", lambda self, large: False)
    base = [f"w{k}" for k in range(160)]
    docs = [(i, " ".join([*base[:i % 160], f"x{i}", *base[i % 160 + 1 :]])) for i in range(256)]
    docs += [(1000 + i, " ".join(f"y{i}z{k}" for k in range(40))) for i in range(20)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 1000 else i for i, _ in docs}
    # All pairs of the 16 blocks of a tree would be 16 rows a member; a deal has one, and then little is left.
    assert sizes[-1][1] is not None and sum(n for n, _ in sizes) < 256 * minhash_dedup.TREES * 8


def test_rows_of_small_nodes_meet_their_node_once(spark, monkeypatch):
    """Only the members of large nodes are looked up by node again, however many rounds those take."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "SMALL", 16)
    again, undecided = [], minhash_dedup.Join.undecided
    monkeypatch.setattr(minhash_dedup.Join, "undecided", lambda self, rows: (again.append(rows.select("cls").distinct().count()), undecided(self, rows))[1])
    base = [f"w{k}" for k in range(160)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    docs += [(1000 + i, " ".join([f"y{i // 2}z{k}" for k in range(40)] + ["end"] * (i % 2))) for i in range(400)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 1000 else i - i % 2 for i, _ in docs}
    assert all(n <= 60 for n in again)


def test_a_bitmap_takes_few_jobs_however_many_partitions(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("shingle"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.range(1).count()
        before = last()
        bitmap = Bitmap.of(keys)
        spark.range(1).count()
        assert 0 <= last() - before <= 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    hashes = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    assert bitmap.has(hashes).all() and Bitmap.of(keys.limit(0)).bits.sum() == 0


def test_intersections_of_a_block_take_little_memory():
    """The 0/1 matrix of a block's sets is never there as a whole, and the sizes are those of the sets."""
    import tracemalloc

    rng = np.random.default_rng(4)
    hashes = [np.unique(rng.integers(0, 2**63, 250, dtype=np.uint64)) for _ in range(256)]
    hashes = [np.unique(np.concatenate([h, hashes[k // 2][: k % 97]])) for k, h in enumerate(hashes)]
    every = np.arange(256)
    tracemalloc.start()
    try:
        found = minhash_dedup._intersections(hashes, every, every[::-1])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sets = [set(h.tolist()) for h in hashes]
    assert all(found[x, y] == len(sets[x] & sets[255 - y]) for x in range(0, 256, 5) for y in range(256))
    assert peak < 48 << 20


def test_arrow_batches_of_long_texts_are_small(spark):
    """What goes to a Python worker at once follows neither the length of texts nor the number of rows."""
    from tickloom.llm.store import prepare

    docs = prepare(spark).range(1500, numPartitions=1).select(F.repeat(F.lit("long text "), 2000).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    sizes = docs.mapInArrow(size, "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 1500 and max(r["size"] for r in sizes) < 4 << 20
