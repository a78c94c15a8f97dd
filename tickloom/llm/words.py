"""Words and their hashes over whole Arrow batches, byte by byte in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
LONG_WORD = 256
PAD = 8


class Piece:
    """Some consecutive texts of a batch: their bytes end to end (padded), and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first = first
        self.n = len(offsets) - 1
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.size = int(self.offsets[-1])
        self.buf = np.zeros(self.size + PAD, np.uint8)
        self.buf[: self.size] = data[offsets[0] : offsets[-1]]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text each byte position belongs to."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def edges(self) -> np.ndarray:
        """True where a text begins."""
        out = np.zeros(self.size + 1, bool)
        out[self.offsets] = True
        return out[: self.size]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), where


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a batch of texts (null: empty) between texts so that numpy's scratch arrays stay small."""
    data, offsets = buffers(texts)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield Piece(data, offsets[low : high + 1], low)
        low = high


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time (``buf`` is padded by eight)."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    length = ends - starts
    out += mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rows, at, left = None, starts, length
    is_long = length > LONG_WORD
    if is_long.any():
        rows = np.flatnonzero(~is_long)
        at, left = starts[rows], length[rows]
        for i in np.flatnonzero(is_long):
            digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
    while True:
        part = eight[at] & _KEEP[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ part)
        else:
            out[rows] = mix(out[rows] ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no edge."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges))
    after = np.ones(len(inside) + 1, bool)
    after[: len(inside)] = ~inside | edges
    ends = np.flatnonzero(inside & after[1:]) + 1
    return starts, ends


def byte_class(pattern_bytes: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[pattern_bytes] = True
    return out


# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing, and [^\x20\x09-\x0D].
PLAIN_WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
SOLID_WORD = byte_class([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])


def words_of(piece: Piece, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text and one past the last)."""
    low = lower_ascii(piece.buf)
    starts, ends = spans(kind[low[: piece.size]], piece.edges())
    return low, starts, ends, np.searchsorted(starts, piece.offsets)


def shingles(h: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of every run of ``width`` words; a text with fewer, but some, words gives one of them all."""
    counts = np.diff(firsts)
    n = len(h)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        if n - k <= 0:
            break
        total[: n - k] = mix(total[: n - k] ^ h[k:])
    text_of = np.repeat(np.arange(len(counts)), counts)
    room = firsts[1:][text_of] - np.arange(n) >= width
    values, owner = total[room], text_of[room]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = np.array([fold(h[firsts[i] : firsts[i + 1]]) for i in few], np.uint64)
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, owner


def fold(h: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for x in h:
        total = mix(total ^ x)
    return total[0]
