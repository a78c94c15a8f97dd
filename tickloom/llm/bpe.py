"""Token ids as the tokenizers library gives them, faster for common characters.

The merges run in tiktoken on the library's own vocabulary. Texts with characters
outside ``COMMON``, with ``<|`` or with very long runs go to the library itself.
``tests/llm/test_tokens.py`` holds both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space, ASCII and the Latin-1 letters: here lower case, normal form and character classes
# are the same in every library.
RARE = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
LONG = 800
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The pre-tokens of both vocabularies in texts without RARE characters.
BYTE_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")
LOWER_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
MARKS = re.compile(r"'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")


def byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, the other way round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Pre-token -> its ids as bytes. The first ones met are remembered, all others are merged each time."""

    MOST = 1 << 19
    LONGEST = 32

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = array("H", self.merge(word)).tobytes()
        if len(self) < self.MOST and len(word) <= self.LONGEST:
            self[word] = ids
        return ids


class _Library:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.two_bytes = self.library.get_vocab_size() <= 1 << 16

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def runs_are_long(text: str, parts: list[str]) -> bool:
        """Runs of one class so long that only the library's merge keeps its speed."""
        solid = sum(map(len, parts))
        return len(text) > LONG and (max(map(len, parts), default=0) > LONG or len(text) - solid > LONG + 2 * len(parts))


class WordBpe(_Library):
    """BPE with word ends (lower-casing, white space dropped)."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        self.end = " "
        to_byte, ranks = byte_of(), {}
        for token, rank in json.load(open(path))["model"]["vocab"].items():
            if not token.startswith("<|"):
                ends = token.endswith("</w>")
                body = token[: -len("</w>")] if ends else token
                ranks[bytes(to_byte[c] for c in body) + b" " * ends] = rank
        # A space after each word stands for the word end; white space never is part of a token.
        self.fast = tiktoken.Encoding("word", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.memory = Remembered(lambda word: self.plain(word) if len(word) > LONG else self.fast.encode_ordinary(word + " "))

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The pre-tokens of a text of common characters, else None."""
        if RARE.search(text) or "<|" in text:
            return None
        parts = MARKS.sub(r" \g<0> ", text.lower()).split()
        return None if _Library.runs_are_long("", parts) or max(map(len, parts), default=0) > LONG else parts

    def merge(self, words: list[str]) -> np.ndarray:
        return self.fast.encode_to_numpy(" ".join(words) + " ", disallowed_special=()) if words else np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        words = self.words(text)
        return self.plain(text) if words is None else self.merge(words)

    def packed(self, text: str) -> np.ndarray:
        """``encode`` out of remembered pre-tokens, two bytes an id where the vocabulary allows."""
        if not self.two_bytes or RARE.search(text) or "<|" in text:
            return self.encode(text)
        return np.frombuffer(b"".join(map(self.memory.__getitem__, LOWER_WORDS.findall(text.lower()))), "<u2")

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings that the library encodes, alone, as exactly their one token."""
        to_byte, strings, ids = byte_of(), [], []
        for token, rank in self.library.get_vocab().items():
            if token.endswith("</w>"):
                try:
                    strings.append(bytes(to_byte[c] for c in token[: -len("</w>")]).decode())
                    ids.append(rank)
                except (UnicodeDecodeError, KeyError):
                    continue
        done = self.library.encode_batch(strings, add_special_tokens=False)
        return sorted(s for s, rank, e in zip(strings, ids, done, strict=True) if e.ids == [rank])


class ByteBpe(_Library):
    """Byte-level BPE (case and white space kept)."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        to_byte = byte_of()
        ranks = {
            bytes(to_byte[c] for c in token): rank
            for token, rank in json.load(open(path))["model"]["vocab"].items()
            if not token.startswith("<|")
        }
        self.fast = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory = Remembered(lambda word: self.plain(word) if len(word) > LONG else self.fast.encode_ordinary(word))

    def encode(self, text: str) -> np.ndarray:
        if RARE.search(text) or "<|" in text or self.runs_are_long(text, text.split()):
            return self.plain(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def packed(self, text: str) -> np.ndarray:
        """``encode`` out of remembered pre-tokens, two bytes an id where the vocabulary allows."""
        if not self.two_bytes or RARE.search(text) or "<|" in text:
            return self.encode(text)
        return np.frombuffer(b"".join(map(self.memory.__getitem__, BYTE_WORDS.findall(text))), "<u2")


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
