"""Language and toxicity models on texts with known answers."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid, toxicity
from tickloom.llm.words import Piece, mix

STEMS = {"aa": ["the", "and", "ing", "tion", "wh"], "bb": ["el", "que", "ñor", "ción", "lla"], "cc": ["ich", "sch", "ung", "über", "keit"]}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(rng: random.Random) -> list[tuple[str, str]]:
    rows = [(sentence(rng, lang, rng.randint(5, 60)), lang) for lang in STEMS for _ in range(60)]
    greek = "λόγος καὶ νόμος " * 5
    return rows + [(greek, "el")] * 40 + [(None, "aa"), ("", "bb"), (sentence(rng, "aa", 9), None)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(corpus(random.Random(1)), "text string, lang string"))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    for n, k in ((1, 2), (2, 3), (6, 3), (7, 2), (5, 1)):
        for _ in range(30):
            scores, penalty = rng.normal(size=(n, k)) * 4, float(rng.uniform(0, 6))
            value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            best = max(value(p) for p in itertools.product(range(k), repeat=n))
            assert value(langid.viterbi(scores, penalty).tolist()) == pytest.approx(best)


def test_languages_spans_and_unknown(spark, model):
    rng = random.Random(2)
    first, second = sentence(rng, "aa", 40), sentence(rng, "cc", 25)
    texts = [sentence(rng, lang, 30) for lang in ("aa", "bb", "cc")] + ["νόμος λόγος", f"{first}. {second}", None, "", "123 !? ×", "漢字", first * 200]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["aa", "bb", "cc", "el", "aa"]
    assert [s["lang"] for s in got[4]["lang_spans"]] == ["aa", "cc"]
    raw = texts[4].encode()
    parts = [raw[s["start"] : s["end"]].decode() for s in got[4]["lang_spans"]]
    assert abs(len(parts[0]) - len(first)) < 20 and parts[1].endswith(second[-20:])
    assert 0.5 < got[4]["score"] < 0.9
    for i in (5, 6, 7):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["lang_spans"]) == ("und", 0.0, [])
    assert (got[8]["lang_pred"], got[8]["score"]) == ("aa", 0.25)  # a script that nobody uses
    assert got[9]["lang_pred"] == "aa"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert toxicity.fit(spark.createDataFrame([], "text string, label int")) == {}
    assert max(r["score"] for r in toxicity.score(docs, {}).collect()) < 1e-300


def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]

    def text(bad: bool) -> str:
        out = rng.choices(plain, k=rng.randint(3, 80))
        if bad:
            out += rng.choices(["vileness", "vilest", "Scum"], k=2)
        rng.shuffle(out)
        return " ".join(out)

    labelled = [(text(b), int(b)) for b in (i % 4 == 0 for i in range(1200))] + [(None, 0), ("", 0), ("same", 0), ("same", 1), ("x", None)]
    weights = toxicity.fit(spark.createDataFrame(labelled, "text string, label int").repartition(3))
    assert 0 < len(weights) < 20_000
    fresh = [(i, text(i % 3 == 0), "clash") for i in range(300)] + [(1000, None, ""), (1001, "", ""), (1002, "a" * 200_000, "")]
    docs = spark.createDataFrame(fresh, "doc_id long, text string, slot string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    right = sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    assert right >= 285  # 95 %
    assert got[1000] == got[1001] and got[1000] < 0.5 and got[1002] < 0.5
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_every_letter_belongs_to_a_script(spark):
    """Rare scripts are learned like any other; clashing columns give way."""
    words = {"syr": "ܫܠܡܐ ܥܠܡܐ ܟܬܒܐ", "div": "ދިވެހި ރާއްޖެ", "nqo": "ߒߞߏ ߞߊ߲ߜߍ", "wide": "ＨＥＬＬＯ ｗｏｒｌｄ", "cop": "ⲁⲃⲅ ⲇⲉⲍ", "kana": "ｱｲｳ ｴｵｶ"}
    model = langid.fit(spark.createDataFrame([(w * k, lang) for lang, w in words.items() for k in (1, 2, 3)], "text string, lang string"))
    texts = [*words.values(), "ª", "º µ", "ℂℝ", "€ ™ “”", "\ufeff", "！？", "\ufe0f", "͵ͷ"]
    docs = spark.createDataFrame([(i, t, "x", 7.0, "y") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double, lang_score string")
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert langid.predict(docs, model).columns == ["doc_id", "text", "lang_pred", "score", "lang_spans"]
    assert [rows[i]["lang_pred"] for i in range(len(words))] == list(words)
    for i in range(len(words), len(texts)):
        has_letter = any(unicodedata.category(c).startswith("L") for c in texts[i])
        assert (rows[i]["lang_pred"] != "und") == has_letter and (rows[i]["score"] > 0) == has_letter, texts[i]
    assert langid.identify(docs, model).count() == len(texts)


def test_letters_follow_unicode():
    """Common ranges: what the byte tables call a letter is one for Unicode, too."""
    for low, high in ((0x41, 0x250), (0xFF00, 0xFFE0)):
        for code in range(low, high):
            raw = np.frombuffer(chr(code).encode(), np.uint8)
            piece = Piece(raw, np.array([0, len(raw)]), 0)
            letter = unicodedata.category(chr(code)) in ("Lu", "Ll", "Lt", "Lo", "Lm")
            assert bool(langid.letters_of(piece)[0].any()) == letter, hex(code)


def test_learner_equals_the_plain_algorithm(spark, monkeypatch):
    """FTRL-proximal with dictionaries, part by part, averaged after each pass."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    data = [(" ".join(rng.choices(words, k=rng.randint(1, 12))) + f" id{i}", int(rng.random() < 0.3)) for i in range(300)]
    frame = spark.createDataFrame(data, "text string, label int")
    keyed = [(r["k"], r["text"], r["label"]) for r in frame.select(F.xxhash64("text").alias("k"), "text", "label").collect()]
    bias = 1 << toxicity.BITS
    z, n = {}, {}
    for turn in range(2):
        changes = []
        for part in range(toxicity.PARTS):
            rows = [x for x in keyed if x[0] % toxicity.PARTS == part]
            order = np.argsort(mix(np.array([x[0] for x in rows], np.int64).view(np.uint64) + np.uint64(turn)), kind="stable")
            pz, pn = dict(z), dict(n)
            for k in order:
                (_, slots, _), = toxicity.text_features(pa.array([rows[k][1]]))
                at = [*slots.tolist(), bias]
                w = {}
                for i in at:
                    zi, l1 = pz.get(i, 0.0), 0.0 if i == bias else toxicity.L1
                    w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(pn.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)
                g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][2]
                for i in at:
                    old = pn.get(i, 0.0)
                    pz[i] = pz.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                    pn[i] = old + g * g
            changes.append((pz, pn))
        for state, which in ((z, 0), (n, 1)):
            keys = {i for c in changes for i in c[which]}
            fresh = {i: state.get(i, 0.0) + sum(c[which].get(i, state.get(i, 0.0)) - state.get(i, 0.0) for c in changes) / len(changes) for i in keys}
            state.update(fresh)
    want = {}
    for i, zi in z.items():
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(zi) > l1:
            want[i] = -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    got = toxicity.fit(frame, passes=2)
    assert set(got) == set(want)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_equal_texts_score_the_same(spark):
    weights = {k: math.sin(k) for k in range(0, 1 << toxicity.BITS, 3)}
    rng = random.Random(2)
    same = " ".join(f"w{rng.randint(0, 999)}" for _ in range(400))
    texts = [same if k % 3 == 0 else " ".join(f"w{rng.randint(0, 9999)}" for _ in range(k)) for k in range(90)]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    out = toxicity.score(docs, weights)
    assert out.columns == ["doc_id", "text", "score"]
    assert len({r["score"] for r in out.collect() if r["doc_id"] % 3 == 0}) == 1


def test_the_passes_leave_nothing_behind(spark, monkeypatch):
    """States broadcast for a pass are given up after it, and the sample is dealt once and dropped at the end."""
    from pyspark import Broadcast

    given_up, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: (given_up.append(self), destroy(self, *a, **k))[1])
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    frame = spark.createDataFrame([(f"some words {i} awful", i % 2) for i in range(60)], "text string, label int")
    assert toxicity.fit(frame, passes=3)
    assert len(given_up) == 3 and spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_driver_collects_the_state_in_pieces(spark, monkeypatch):
    """No result holds a row for every coordinate that was learned, and none holds all blocks of the state."""
    from pyspark.sql import DataFrame

    data = [(" ".join(f"w{random.Random(i).randrange(4000)}x{k}" for k in range(40)), i % 2) for i in range(200)]
    frame = spark.createDataFrame(data, "text string, label int")
    kind, sizes, streamed = type(frame), [], []
    assert issubclass(kind, DataFrame)
    for name, size in (("toArrow", lambda x: x.num_rows), ("toPandas", len), ("collect", len)):

        def fetch(df, real=getattr(kind, name), size=size):
            sizes.append(size(out := real(df)))
            return out

        monkeypatch.setattr(kind, name, fetch)

    def iterate(df, *args, real=kind.toLocalIterator, **named):
        for row in real(df, *args, **named):
            streamed.append(len(row["z"]) + len(row["n"]))
            yield row

    monkeypatch.setattr(kind, "toLocalIterator", iterate)
    assert toxicity.fit(frame, passes=2)
    assert max(sizes, default=0) < 10
    # Twice every block at most, each in a row of its own.
    blocks = -(-((1 << toxicity.BITS) + 1) // toxicity.BLOCK)
    assert 0 < len(streamed) <= 2 * blocks and max(streamed) <= 16 * toxicity.BLOCK


def test_features_and_passes_take_little_memory():
    """Features are found in short pieces, and a pass over a part has one copy of the state."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randrange(5000)}" for _ in range(400)) for _ in range(600)]
    state = tuple(np.ones((1 << toxicity.BITS) + 1) for _ in "zn")
    rows = pa.RecordBatch.from_pydict({"key": list(range(600)), "label": [k % 2 for k in range(600)], "text": texts, "part": [0] * 600})
    tracemalloc.start()
    try:
        assert sum(n for n, _, _ in toxicity.text_features(pa.array(texts))) == 600
        features = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        (moved,) = toxicity._trainer(1, SimpleNamespace(value=state))(iter([rows]))
        learned = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert moved.num_rows and features < 24 << 20 and learned < 48 << 20
