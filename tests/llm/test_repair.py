"""Conversation repair against every possible list of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tickloom.llm import queries, repair
from tickloom.llm.repair import Repair, damaged

VALID = re.compile("(s?(ua)+)?")
LAST = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, hash) of rows (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        solid = LAST.findall(text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    choices = []
    inserts = [[("I", r, "", 3) for r in roles] for k in range(3) for roles in itertools.product(("user", "assistant"), repeat=k)]
    for (role, text), fault in zip(rows, faults):
        own = [("D", None, None, 4)]
        if fault not in ("b", "d"):
            more = 3 * (fault == "t")
            own += [("K", role, text, more), ("R", "user", text, 3 + more), ("R", "assistant", text, 3 + more)]
        choices.append([[*i, o] for i in inserts for o in own])
    choices.append(inserts)
    best = None

    def go(k, done):
        nonlocal best
        cost = sum(e[3] for e in done)
        if best and cost > best[0]:
            return
        if k == len(choices):
            kept = [e for e in done if e[0] != "D"]
            if VALID.fullmatch("".join(e[1][:1] or "?" for e in kept)):
                mine = (cost, "".join(e[0] for e in done), "\n".join(f"{e[1]}:{e[2]}" for e in kept))
                best = min(best, mine) if best else mine
            return
        so_far = "".join((e[1][:1] or "?") for e in done if e[0] != "D")
        if re.fullmatch("(s?(ua)*u?)?", so_far):
            for part in choices[k]:
                go(k + 1, done + part)

    go(0, [])
    count = lambda f: faults.count(f)
    return count("b"), count("d"), count("t"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def conversations():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "sage"], ["Yes.", "No", "Why?", " \t", "", None, "Oh!  \n", "a.b"]
    out = {}
    for conv in [None, *range(120)]:
        out[conv] = [(None if rng.random() < 0.1 else k, rng.choice(roles), rng.choice(texts)) for k in range(rng.randint(1, 4))]
    return out


def in_order(rows):
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))


def results(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string, fault string")
    made = Repair(frame)
    digests = {r["conv_id"]: r for r in made.digests().collect()}
    counts = {r["conv_id"]: r for r in made.counts().collect()}
    fields = ("blank", "duplicate", "truncated", "illegal", "cost")
    return {c: (*(counts[c][f] for f in fields), digests[c]["audit"], digests[c]["repaired_sha256"]) for c in counts}, made


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_cheapest_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "OUT_ROWS", 3)
    data = conversations()
    got, made = results(spark, [(c, t, r, x, "clash", "clash") for c, rows in data.items() for t, r, x in rows])
    for conv, rows in data.items():
        assert got[conv] == brute([row[1:] for row in in_order(rows)]), rows
    gaps = {r["conv_id"]: r["gaps"] for r in made.counts().collect()}
    for conv, rows in data.items():
        turns = [t for t, _, _ in rows if t is not None]
        assert gaps[conv] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_log_rebuilds_the_rows(spark):
    _, made = results(spark, [(1, 0, "user", "Hi.", "", ""), (1, 1, "user", "Hi.", "", ""), (1, 2, "user", "Why?", "", ""), (1, 3, "assistant", "So.", "", "")])
    rows = [("user", "Hi."), ("user", "Hi."), ("user", "Why?"), ("assistant", "So.")]
    log = sorted(made.log().collect(), key=lambda r: r["number"])
    assert "".join(r["edit"] for r in log) == brute(rows)[5] and [r["number"] for r in log] == list(range(len(log)))
    assert [(r["role"], r["text"]) for r in log if r["turn"] is not None] == rows
    assert "".join(r["role"][0] for r in log if r["edit"] != "D") in ("ua", "uaua")


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = Repair(frame)
    assert made.log().count() == 0 and made.counts().count() == 0 and made.digests().count() == 0


def test_long_conversation_in_small_blocks(spark, monkeypatch):
    rows = [(5, k, ("user", "assistant")[k % 2], f"{k}{'.' if k % 7 else ''}", "", "") for k in range(5000)]
    whole, _ = results(spark, rows)
    monkeypatch.setattr(repair, "BLOCK", 64)
    assert results(spark, rows)[0] == whole
    assert whole[5][5] == "K" * 5000 and whole[5][4] == 3 * whole[5][2]


def test_very_long_text(spark):
    got, _ = results(spark, [(1, 0, "user", "x " * 2_000_000 + ".", "", ""), (1, 1, "assistant", "y" * 1_000_000, "", "")])
    assert got[1][:6] == (0, 0, 1, 0, 3, "KK")


def test_damage(spark):
    rows = [(c, t, "assistant", "a.b!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert got == sorted(want, key=str)


def test_query_of_a_small_table(spark, tmp_path):
    data = [(c, t, ("system", "user", "assistant")[min(t, 2 - t % 2)], f"{t}!") for c in range(30) for t in range(4)] + [(99, 27, "user", "x")]
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    data += [(gone + 1000, None, None, None), (gone, 0, "user", "dropped.")] if gone >= 30 else [(gone + 1000, None, None, None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.QUERIES["op12_conversation_repair"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {c for c, *_ in data}
    kept = {}
    for r in damaged(frame).collect():
        kept.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for conv, row in got.items():
        fields = tuple(row[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
        want = brute([x[1:] for x in in_order(kept[conv])]) if conv in kept else (0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
        assert fields == want
