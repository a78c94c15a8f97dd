"""WARC records and chat turns come back as they went in."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm.chat import format_conversations, read_conversations, render_turns
from tickloom.llm.warc import parse_records, read_records, write_archive

PAGES = [
    (1, "http://a/", "same"), (3, "http://b/", "same"), (2, "http://c/\r\nX: y", "same"), (4, None, None), (5, "u", ""),
    (9, "twice", "again"), (9, "twice", "again"), (None, "n", "same"), (6, "ü", "größe" * 5000),
]


def test_records_point_to_the_largest_page(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, content string")
    records = read_records(spark, write_archive(pages)).cache()
    got = sorted(parse_records(records).collect(), key=str)
    assert len(got) == len(PAGES)
    by = {r["page_id"]: r for r in got if r["page_id"] != 9}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for page, _, html in PAGES:
        if page != 9:
            assert (by[page]["payload_bytes"], by[page]["payload_digest"]) == (len((html or "").encode()), digest(html or ""))
    assert {p: (by[p]["record_type"], by[p]["refers_to"]) for p in (1, 2, 3, 4, 5, 6, None)} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None),
        6: ("response", None), None: ("revisit", 3),
    }
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 9) == [("response", None), ("revisit", 9)]
    for r in records.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\nX: y" not in head
        length = int(head.split(b"Content-Length: ")[1])
        assert block[length:] == b"\r\n\r\n"


def test_small_payloads_are_not_shared_and_nothing_is_fine(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    types = {r["record_type"] for r in parse_records(read_records(spark, write_archive(pages, min_payload_bytes=10**6))).collect()}
    assert types == {"response"}
    assert parse_records(read_records(spark, write_archive(pages.limit(0)))).count() == 0


TEXTS = [
    None, "", "plain", "\\### Assistant: </turn> ok", "</turn>\n### User: x", "<\\/turn>", "\\", "\\\\", "### ", "#### # ###", "</turn", "a\\\nb",
    "</</turn>turn>", "##\\# ", "### " * 4, "🙂</turn>", "x" * 50_000,
]
ROLES = ["user", "assistant", "system", "User", None, "", "a: b", "=", "=user", "x\ny", "</turn>", "### "]


def test_turns_survive(spark):
    rng = random.Random(3)
    parts = ["\\", "</turn>", "### ", ": ", "\n", "#", "<", "/turn>", "user", " ", "="]
    texts = TEXTS + ["".join(rng.choices(parts, k=8)) for _ in range(200)]
    roles = ROLES + ["".join(rng.choices(parts, k=4)) for _ in range(30)]
    data = [(c, t, rng.choice(roles), x) for c in (1, 2, None) for t, x in enumerate(texts)] + [(4, None, "assistant", "b"), (4, None, "assistant", "a"), (4, 0, "user", "a")]
    turns = spark.createDataFrame([(*d, "clash") for d in data], "conv_id long, turn long, role string, text string, rendered string")
    out = format_conversations(turns.repartition(5)).cache()
    want: dict = {}
    for c, t, r, x in sorted(data, key=lambda d: (d[0] is not None, d[0], d[1] is not None, d[1], d[2] or "", d[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read_conversations(out).collect()} == want
    loss = {r["conv_id"]: r["loss_texts"] for r in read_conversations(out).collect()}
    # A mask that is off by one character shows.
    moved = out.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    assert all(r["loss_texts"] != loss[r["conv_id"]] for r in read_conversations(moved).collect())
    for r in out.collect():
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert loss[r["conv_id"]] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert len(spans) == sum(role == "assistant" for role, _ in want[r["conv_id"]])
        for span, (_, text) in zip(spans, [t for t in want[r["conv_id"]] if t[0] == "assistant"]):
            assert span == text or "\\" in span
    assert format_conversations(turns.limit(0)).count() == 0


def test_only_conflicting_turns_are_escaped(spark):
    turns = spark.createDataFrame([(1, 0, "user", "plain # <turn> text"), (1, 1, "user", "</turn>")], "conv_id long, turn long, role string, text string")
    got = [r["rendered"] for r in render_turns(turns).orderBy("turn").collect()]
    assert got == ["### User: plain # <turn> text", "### User: <\\/turn>"]
    assert "</turn>" not in got[1].split(": ", 1)[1]
