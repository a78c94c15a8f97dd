"""Conversation structure repair: the cheapest edits that make the roles a valid dialogue.

Rows are kept, given another role, deleted, or empty ones inserted, so that the roles read
system (or not), then user and assistant in turn, ending with assistant, or nothing at all.
Between rows only four things matter: nothing kept yet (E), a system row kept (S), a user row (U), an
assistant row (A). So the cheapest completion from each of them, computed from the last row to the
first, is all a stream has to carry, and two bytes a row say which edit each of the four takes.

Every pass repartitions by conversation and sorts within it, then streams:

1. forwards over the texts: positions and fault classes (``ranked``, stored);
2. backwards over one byte a row: costs to go are carried from batch to batch, the choices of every ``BLOCK`` rows
   are given out as one row of a stored table, so a conversation of any length holds one block in memory;
3. forwards over those blocks: the edits, block by block;
4. forwards over texts and edits together: the edit log.

Repeated texts are found beside pass 1 by the smallest position of each text, not by a set in memory.

Defined results: null roles and texts are one space; null turns come first, a null conversation is one of
its own; rows of equal turns are ordered by role and text; rows equal in all that matter are repetitions.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.skew import lookup
from tickloom.llm.store import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"  # in ASCII order: the smaller choice wins a tie
E, S, U, A = range(4)
GIVES = (U, U, A, U)  # the state after a row that alternates
ROLE = {S: "system", U: "user", A: "assistant"}
BLOCK = 1 << 20
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT, FINE = range(4)
KINDS = {"s": 1, "u": 2, "a": 3}  # 0: must go, 4: any other role
LEGAL = {"su", "ua", "au"}
OUT_ROWS = 4096


@lru_cache(maxsize=None)
def step(after: tuple[int, ...], kind: int, truncated: int) -> tuple[tuple[int, ...], int, int]:
    """(costs to go before a row, less their minimum; that minimum; the choice of each state in two bits).

    ``after`` are the costs to go behind the row. Bit 8 says that keeping it in state E gives S.
    """
    extra = TRUNCATED * truncated
    options: list[dict[str, int]] = []
    for state in range(4):
        found = {"D": DELETE + after[state]}
        if kind:
            found["R"] = REROLE + extra + after[GIVES[state]]
        if kind == 1 and state == E:
            found["K"] = KEEP + extra + after[S]
        elif kind == (3 if state == U else 2):
            found["K"] = KEEP + extra + after[GIVES[state]]
        options.append(found)
    before = [min(found.values()) for found in options]
    for _ in range(3):
        before = [min(before[state], INSERT + before[GIVES[state]]) for state in range(4)]
    choice = 0x100 if kind == 1 else 0
    for state, found in enumerate(options):
        found["I"] = INSERT + before[GIVES[state]]
        best = min(letter for letter, cost in found.items() if cost == before[state])
        choice |= LETTERS.index(best) << 2 * state
    low = min(before)
    return tuple(x - low for x in before), low, choice


LAST = (0, 2 * INSERT, INSERT, 0)  # behind the last row: insert what is missing


@lru_cache(maxsize=1 << 14)
def follow(choice: int, state: int) -> tuple[str, int]:
    """The edits up to and including that of one row, and the state behind it."""
    edits = ""
    while True:
        letter = LETTERS[choice >> 2 * state & 3]
        edits += letter
        if letter == "I":
            state = GIVES[state]
            continue
        if letter != "D":
            state = S if letter == "K" and state == E and choice & 0x100 else GIVES[state]
        return edits, state


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _streamed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a generator in batches of bounded number and size (texts count)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= OUT_ROWS or size >= 1 << 24:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


_NONE = object()


def _rank(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Positions, fault classes (repetitions aside), and marks from which sums give the counts."""
    conv, pos, last_turn, last = _NONE, 0, None, ""
    for conv_id, turn, role, text in rows:
        if conv is _NONE or conv_id != conv:
            conv, pos, last_turn, last = conv_id, 0, None, None
        end = text.rstrip(WHITE)[-1:]
        fault = BLANK if not end else FINE if end in ".!?" else CUT
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        illegal = int(last is not None and last + role[:1] not in LEGAL)
        new_turn = int(turn is not None and turn != last_turn)
        yield conv_id, pos, pos // BLOCK, turn, role, text, fault, KINDS.get(role[:1], 4), digest, illegal, new_turn
        pos, last_turn, last = pos + 1, turn, role[:1]


def _choices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the last row to the first: one row of choices per block; the first block has the cost."""
    conv, block, held, tail, costs, total = _NONE, None, bytearray(), True, LAST, 0
    for conv_id, pos, of, fault, kind in rows:
        if conv is _NONE or conv_id != conv:
            conv, block, tail, costs, total = conv_id, of, True, LAST, 0
        costs, low, choice = step(costs, 0 if fault in (BLANK, DUPLICATE) else kind, int(fault == CUT))
        total += low
        held += choice.to_bytes(2, "little")
        if pos % BLOCK == 0:
            yield conv_id, of, tail, bytes(held), total + costs[E] if pos == 0 else None
            held, tail = bytearray(), False


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the first block to the last: the edits of each, and the state before them."""
    conv, state = _NONE, E
    for conv_id, block, tail, choices in rows:
        if conv is _NONE or conv_id != conv:
            conv, state = conv_id, E
        before, out = state, []
        for k in range(len(choices) - 2, -2, -2):
            edits, state = follow(choices[k] | choices[k + 1] << 8, state)
            out.append(edits)
        if tail:
            out.append({U: "I", S: "II"}.get(state, ""))
        yield conv_id, block, before, "".join(out)


def _log(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits and rows together: one row of the log per edit, in order."""
    conv, number = _NONE, 0
    state, edits, at = E, "", 0

    def inserted() -> Iterator[tuple]:
        nonlocal state, at, number
        while at < len(edits) and edits[at] == "I":
            state = GIVES[state]
            yield conv, number, "I", None, ROLE[state], ""
            at, number = at + 1, number + 1

    for conv_id, kind, turn, role, text, before, block_edits in rows:
        if kind == 0:
            yield from inserted()  # behind the rows of the block before
            if conv is _NONE or conv_id != conv:
                conv, number = conv_id, 0
            state, edits, at = before, block_edits, 0
            continue
        yield from inserted()
        letter = edits[at]
        if letter == "R":
            state = GIVES[state]
            role = ROLE[state]
        elif letter == "K":
            state = S if role[:1] == "s" else GIVES[state]
        yield conv, number, letter, turn, role, text
        at, number = at + 1, number + 1
        if at == len(edits) or edits[at:].strip("I") == "":
            yield from inserted()


class Repair:
    """``log``: one row per edit. ``counts``: one row per conversation with rows."""

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        quoted = lambda name: F.col(f"`{name}`")
        rows = turns.select(
            quoted(conv).alias("conv_id"),
            quoted(turn).cast("long").alias("turn"),
            F.coalesce(quoted(role), F.lit(" ")).alias("role"),
            F.coalesce(quoted(text), F.lit(" ")).alias("text"),
        )
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        self.ranked = stored(
            self._stream(
                rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text"),
                _rank,
                "pos long, block long, turn long, role string, text string, fault int, kind int, digest binary, illegal int, new_turn int",
            ),
            "ranked",
        )
        self.classes = self._classes()
        order = self.classes.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
        fields = "block long, tail boolean, choices binary, cost long"
        self.choices = stored(self._stream(order.select("conv_id", "pos", "block", "fault", "kind"), _choices, fields), "choices")
        order = self.choices.repartition("conv_id").sortWithinPartitions("conv_id", "block")
        self.edits = stored(self._stream(order.select("conv_id", "block", "tail", "choices"), _edits, "block long, state int, edits string"), "edits")

    def _stream(self, rows: DataFrame, each, fields: str) -> DataFrame:
        """``each`` over the rows of every partition in their order."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType, _parse_datatype_string

        shape = StructType([rows.schema["conv_id"], *_parse_datatype_string(fields).fields])
        schema = to_arrow_schema(shape)
        return rows.mapInArrow(lambda batches: _streamed(each(_rows(batches)), schema), shape)

    def _classes(self) -> DataFrame:
        """Fault classes with repetitions: a text is one unless it holds the smallest position of its kind."""
        facts = self.ranked.select("conv_id", "pos", "block", "turn", "fault", "kind", "illegal", "new_turn", F.xxhash64("conv_id", "digest").alias("key"), "digest")
        texts = facts.where(F.col("fault") != BLANK)
        first = texts.groupBy("key", "conv_id", "digest").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n > 1")
        # Texts whose 64-bit keys clash are told apart by the whole digest.
        first = first.groupBy("key").agg(F.collect_list(F.struct("conv_id", "digest", "pos")).alias("firsts"))
        same = F.filter("firsts", lambda x: x["conv_id"].eqNullSafe(F.col("conv_id")) & (x["digest"] == F.col("digest")) & (x["pos"] < F.col("pos")))
        found = lookup(facts, first, "key", F.col("pos"), "left")
        repeated = (F.col("fault") != BLANK) & (F.coalesce(F.size(same), F.lit(0)) > 0)
        return stored(found.select("conv_id", "pos", "block", "turn", F.when(repeated, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "kind", "illegal", "new_turn"), "classes")

    def counts(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost``."""
        of = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
        sums = self.classes.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("new_turn"), F.lit(0)).cast("long").alias("gaps"),
            of(BLANK).alias("blank"), of(DUPLICATE).alias("duplicate"), of(CUT).alias("truncated"), F.sum("illegal").cast("long").alias("illegal"),
        )
        cost = self.choices.where(F.col("cost").isNotNull()).select(F.col("conv_id").alias("of"), "cost")
        return sums.join(cost, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def log(self) -> DataFrame:
        """``conv_id, number, edit, turn, role, text``: edits in order, the rows of a conversation in one partition.

        ``role`` and ``text`` are those of the repaired row; of a deleted one (D) what it held.
        """
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
        blocks = self.edits.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("is_row"), *nothing, "state", "edits")
        rows = self.ranked.select("conv_id", "block", "pos", F.lit(1).alias("is_row"), "turn", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"))
        order = blocks.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
        given = order.select("conv_id", "is_row", "turn", "role", "text", "state", "edits")
        return self._stream(given, _log, "number long, edit string, turn long, role string, text string")

    def digests(self) -> DataFrame:
        """``conv_id, audit, repaired_sha256``: initials of the edits; ``role:text`` of the repaired rows, newline-joined."""
        return self._stream(self.log(), _digests, "audit string, repaired_sha256 string")


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, audit, digest, some = _NONE, [], hashlib.sha256(), False
    for conv_id, _, edit, _, role, text in rows:
        if conv is _NONE or conv_id != conv:
            if conv is not _NONE:
                yield conv, "".join(audit), digest.hexdigest()
            conv, audit, digest, some = conv_id, [], hashlib.sha256(), False
        audit.append(edit)
        if edit != "D":
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
    if conv is not _NONE:
        yield conv, "".join(audit), digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the stated faults put in by crc32 of ``conv_id:turn``; nulls as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("fault")
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
