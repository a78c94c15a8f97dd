"""Language identification of mixed text.

A word is a run of letters of one script. The script narrows the languages to those
that use it in the training texts; the word's byte trigrams (with its borders) give a log score
per language; Viterbi with a switching penalty labels the sequence of words,
so that spans of a language come out and single odd words do not. The language of
a text is the one with most letters; its score is its share of the letters.

The model is fitted on a bounded, documented sample (``max_rows`` labelled rows, drawn
by hash over all of them, each text once). Its table has 2 ** ``BITS`` rows of one value per language.

Defined results: a null text or one without letters is ``und`` with score 0 and no spans;
ties go to the alphabetically first language; a text whose scripts no language
uses, or whose only letters are among signs, gets the alphabetically first one with the score of an equal
share. Without training rows every text is ``und``. Input columns named like an output column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import stored
from tickloom.llm.words import Piece, column, lower_ascii, pieces

BITS = 17
MAX_ROWS = 20_000
SWITCH = 14.0
STRANGE = 6.0  # what a word in a script that the language does not use costs
CANDIDATE_SHARE = 0.005
UNKNOWN = "und"

# First byte of a UTF-8 character -> script; the letters of ASCII and of U+00C0 to U+02AF are Latin.
SCRIPTS = {
    "latin": (0xC3, 0xCB), "greek": (0xCE, 0xD0), "cyrillic": (0xD0, 0xD4), "armenian": (0xD4, 0xD6),
    "hebrew": (0xD6, 0xD8), "arabic": (0xD8, 0xDC), "indic": (0xE0, 0xE1), "asian": (0xE1, 0xE2),
    "kana": (0xE3, 0xE4), "han": (0xE4, 0xEA), "hangul": (0xEA, 0xEE), "beyond": (0xF0, 0xF5),
    "syriac": (0xDC, 0xDE), "thaana": (0xDE, 0xDF), "nko": (0xDF, 0xE0), "forms": (0xEF, 0xF0),
}
_LEAD = np.zeros(256, np.uint8)
for _k, (_low, _high) in enumerate(SCRIPTS.values()):
    _LEAD[_low:_high] = _k + 1
_LEAD[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
# Lead bytes of which few characters, or not all, are letters: lead -> (script, lowest and highest second byte).
_FEW = {
    0xC2: (1, ((0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA))),  # feminine, micro, masculine
    0xCD: (2, ((0xB0, 0xBF),)),  # Greek behind the combining marks
    0xE2: (8, ((0xB0, 0xB7),)),  # Glagolitic to Ethiopic; before them marks and signs
    0xEF: (len(SCRIPTS), ((0xA4, 0xB7), (0xB9, 0xBF))),  # compatibility forms, full and half width
}


def _not_letters(buf: np.ndarray) -> np.ndarray:
    """Marks among the compatibility forms: positions of their lead bytes."""
    at = np.flatnonzero(buf == 0xEF)
    if not len(at):
        return at
    padded = np.concatenate([buf, np.zeros(2, np.uint8)])
    code = (padded[at + 1].astype(int) & 0x3F) << 6 | padded[at + 2] & 0x3F
    letters = code < 0xE00
    for low, high in _FORMS:
        letters |= (code >= low) & (code <= high)
    return at[~letters]


# Arabic forms; full-width capitals and small letters; half-width kana and hangul (last three digits).
_FORMS = ((0xE70, 0xEFC), (0xF21, 0xF3A), (0xF41, 0xF5A), (0xF66, 0xFBE), (0xFC2, 0xFC7), (0xFCA, 0xFCF), (0xFD2, 0xFD7), (0xFDA, 0xFDC))


def letters_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(script of each byte, 0 outside letters; lower-cased bytes with spaces outside letters)."""
    buf = piece.buf[: piece.size]
    script = _LEAD[buf]
    # Signs among the two- and three-byte characters: multiplication, division, ideographic marks.
    after = piece.buf[1 : piece.size + 1]
    script[(buf == 0xC3) & ((after == 0x97) | (after == 0xB7))] = 0
    script[(buf == 0xE3) & (after == 0x80)] = 0
    for lead, (kind, seconds) in _FEW.items():
        at = np.flatnonzero(buf == lead)
        if len(at):
            script[at] = np.where(np.logical_or.reduce([(after[at] >= a) & (after[at] <= b) for a, b in seconds]), kind, 0)
    script[_not_letters(buf)] = 0
    inner = (buf & 0xC0) == 0x80
    for _ in range(3):  # continuation bytes follow their first byte
        at = np.flatnonzero(inner & (script == 0))
        at = at[at > 0]
        script[at] = script[at - 1]
    low = lower_ascii(buf)
    latin1 = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) if len(buf) > 1 else np.zeros(0, np.int64)
    low[latin1 + 1] += 0x20
    low[script == 0] = 0x20
    return script, low


def script_words(script: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one script."""
    change = np.ones(len(script) + 1, bool)
    change[1:-1] = script[1:] != script[:-1]
    change[: len(script)] |= edges
    starts = np.flatnonzero((script > 0) & change[:-1])
    ends = np.flatnonzero((script > 0) & change[1:]) + 1
    return starts, ends


def trigram_slots(low: np.ndarray) -> np.ndarray:
    """Slot of the three bytes around each position (before, at, after)."""
    padded = np.full(len(low) + 2, 0x20, np.uint32)
    padded[1:-1] = low
    value = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x languages: log probability less the mean over languages
    uses: np.ndarray  # scripts x languages: whether the language uses the script


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    each = F.lit(float(max_rows)) / F.greatest(F.lit(1), F.lit(counts.count()))
    keyed = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(counts), "lang")
    picked = keyed.where(F.pmod("key", F.lit(1 << 30)) < F.least(F.lit(1.0), each / F.col("_n")) * (1 << 30))
    return picked.groupBy("lang", "key").agg(F.first("text").alias("text"))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Model from rows of (text, lang); null texts and null languages are left out."""
    known = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sample = stored(_sample(known, max_rows), "lang-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    index = {x: i for i, x in enumerate(languages)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), 1 << BITS), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            which = np.array([index[x] for x in column(batch, "lang").to_pylist()], np.int64)
            for piece in pieces(column(batch, "text")):
                script, low = letters_of(piece)
                slots = trigram_slots(low)
                inside = np.flatnonzero(script > 0)
                of = which[piece.first + piece.owner(inside)]
                for k in np.unique(of):
                    mine = inside[of == k]
                    grams[k] += np.bincount(slots[mine], minlength=1 << BITS)
                    scripts[k] += np.bincount(script[mine], minlength=len(SCRIPTS) + 1)
        k, slot = np.nonzero(grams)
        ks, s = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([k, ks]).astype(np.int32)),
                pa.array(np.concatenate([slot, -1 - s]).astype(np.int32)),
                pa.array(np.concatenate([grams[k, slot], scripts[ks, s]])),
            ],
            names=["k", "slot", "n"],
        )

    counts = sample.select("text", "lang").mapInArrow(tally, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    gram = counts[counts.slot >= 0]
    grams[gram.slot, gram.k] = gram.n
    kind = counts[counts.slot < 0]
    scripts[-1 - kind.slot, kind.k] = kind.n
    log = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS)))
    log -= log.mean(1, keepdims=True) if languages else 0
    uses = scripts >= CANDIDATE_SHARE * np.maximum(1, scripts.sum(0))
    return Model(languages, log.astype(np.float32), uses)


def word_scores(model: Model, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words x languages scores) of a piece."""
    script, low = letters_of(piece)
    starts, ends = script_words(script, piece.edges())
    slots = trigram_slots(low)
    scores = np.empty((len(starts), len(model.languages)))
    for k in range(len(model.languages)):
        sums = np.concatenate([[0.0], np.cumsum(model.table[slots, k], dtype=np.float64)])
        scores[:, k] = sums[ends] - sums[starts]
    uses = model.uses[script[starts]] if len(starts) else np.zeros((0, len(model.languages)), bool)
    nobody = ~uses.any(1)
    scores = np.where(uses, scores, scores.min(1, keepdims=True, initial=0.0) - STRANGE)
    scores[nobody] = 0.0
    return starts, ends, scores


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word when every change of label costs ``penalty``."""
    total = scores.sum(0)
    base = int(total.argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    # A detour gains no more than its words prefer other labels, and costs at least one change:
    # where no stretch of words gains more than that, one label is best throughout.
    gain = np.concatenate([[0.0], np.cumsum(np.delete(scores, base, 1).max(1) - scores[:, base])])
    if (gain - np.minimum.accumulate(gain)).max() <= penalty:
        return np.full(len(scores), base)
    rows = scores.tolist()
    state, back = rows[0], []
    for row in rows[1:]:
        top = max(state)
        best, switched = state.index(top), top - penalty
        back.append((best, [x < switched for x in state]))
        state = [(x if x >= switched else switched) + y for x, y in zip(state, row)]
    label = state.index(max(state))
    out = [label]
    for best, moved in reversed(back):
        if moved[label]:
            label = best
        out.append(label)
    return np.array(out[::-1])


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans``: (start byte, end byte, language) of each span."""
    return _found(docs, model, text, penalty).select("row.*", "lang_pred", "lang_score", "lang_spans")


ADDED = ("lang_pred", "lang_score", "lang_spans", "score")


def _found(docs: DataFrame, model: Model, text: str, penalty: float) -> DataFrame:
    """``row`` (the input's columns), ``text`` and what is found in it."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.uses))
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED)).alias("row"), F.col(f"`{text}`").alias("text"))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            pred, score, spans = [], [], []
            for piece in pieces(column(batch, "text")):
                starts, ends, scores = word_scores(model, piece) if model.languages else (np.zeros(0, np.int64),) * 3
                first = np.searchsorted(starts, piece.offsets)
                for i in range(piece.n):
                    a, b = first[i], first[i + 1]
                    if a == b:
                        pred.append(UNKNOWN), score.append(0.0), spans.append([])
                        continue
                    label = viterbi(scores[a:b], penalty)
                    size = np.bincount(label, weights=ends[a:b] - starts[a:b], minlength=len(model.languages))
                    k = int(size.argmax())
                    pred.append(model.languages[k])
                    known = scores[a:b].any()
                    score.append(float(size[k] / size.sum()) if known else 1.0 / len(model.languages))
                    cut = np.flatnonzero(np.diff(label)) + 1
                    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [b - a]]) - 1
                    zero = piece.offsets[i]
                    spans.append([
                        {"start": int(starts[a + x] - zero), "end": int(ends[a + y] - zero), "lang": model.languages[label[x]]}
                        for x, y in zip(begin.tolist(), end.tolist())
                    ])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                names=[*names, "lang_pred", "lang_score", "lang_spans"],
            )

    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_spans array<struct<start: long, end: long, lang: string>>")


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred, score, lang_spans``; texts without a letter are ``und``."""
    found = _found(docs, model, text, penalty)
    # Some runs of bytes are marks or signs: whether there is a letter at all is Unicode's to say.
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    first, share = (model.languages[0], 1.0 / len(model.languages)) if model.languages else (UNKNOWN, 0.0)
    unseen = F.col("lang_pred") == UNKNOWN
    return found.select(
        "row.*",
        F.when(letter, F.when(unseen, first).otherwise(F.col("lang_pred"))).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(letter, F.when(unseen, share).otherwise(F.col("lang_score"))).otherwise(F.lit(0.0)).alias("score"),
        F.when(letter, F.col("lang_spans")).otherwise(F.array().cast(found.schema["lang_spans"].dataType)).alias("lang_spans"),
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def training_rows(docs: DataFrame, folds: int = 3) -> DataFrame:
    """(text, lang) outside the held-out fold (remainder 1)."""
    return docs.where(fold_of(F.col("doc_id"), folds) != 1).select("text", "lang")
