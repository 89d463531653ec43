"""Byte-level BPE ids of whole texts: those of the ``tokenizers`` library, with a memory of words.

A byte-level BPE never merges across the pieces of its splitting pattern, and a piece always starts
before a space that follows a non-space or precedes one. So a text without three white-space
characters around a space splits at its spaces into words (each with the space before it) whose
ids, in a row, are the text's. Words repeat, so each worker remembers the ids of the first
``MEMORY`` words it meets; unseen words are merged by ``tiktoken`` over the vocabulary read from
the tokenizers file, several times as fast as the library's own call. Texts with characters beyond
Latin script (two Unicode tables might differ), with a special token's string, or with such white
space go to the ``tokenizers`` library whole.
"""

from __future__ import annotations

import array
import functools
import os
import re

#: Words a worker remembers; later words are merged each time they occur.
MEMORY = 300_000
#: Splitting pattern of the vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAR = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\u024f]")
_WIDE_SPACE = re.compile(r"\s \s")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """word (with the space before it) -> its ids as unsigned 32-bit integers."""

    def __init__(self, encode, memory: int):
        super().__init__()
        self.encode, self.memory = encode, memory

    def __missing__(self, word: str) -> bytes:
        ids = array.array("I", self.encode(" " + word)).tobytes()
        if len(self) < self.memory:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in self.tokenizer.get_vocab().items()
                 if token not in special}
        self.merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.words = WordIds(self.merge, memory)

    def packed(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers in native (little-endian) order."""
        if _FAR.search(text) or _WIDE_SPACE.search(text) or self.special.search(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        return array.array("I", self.merge(first)).tobytes() + b"".join(map(self.words.__getitem__, words))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
