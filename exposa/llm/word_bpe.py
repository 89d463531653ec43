"""Ids of a BPE vocabulary with word ends (lower case, white space dropped): those of the ``tokenizers``
library, with a memory of words.

Such a tokenizer never merges across white space, so a text's ids are those of its stretches between
white space in a row. Stretches repeat, so each worker remembers the ids of the first ``MEMORY`` it meets.
Unseen ones are merged by ``tiktoken`` over the vocabulary read from the tokenizers file: the end of a word
is a byte that UTF-8 never uses, and its merge with the last byte goes before all others. Texts with
characters beyond Latin script (normal forms and Unicode tables might differ) or with a special token's
string go to the ``tokenizers`` library whole.
"""

from __future__ import annotations

import array
import functools
import os
import re
import unicodedata

from exposa.llm.bpe import byte_of_symbol

#: Stretches a worker remembers; later ones are merged each time they occur.
MEMORY = 300_000
#: Byte that stands for the end of a word.
WORD_END = b"\xff"
_FAR = re.compile("[^\x00-\x1b\x20-\x7e\xa1-įı-ɏ]")


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's splitting pattern within a stretch of lower-case Latin text.
PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{0}{1}]+".format(_latin("L"), _latin("N")))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """lower-case stretch without white space -> its ids as unsigned 32-bit integers."""

    def __init__(self, path: str, memory: int = MEMORY):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.memory, self.tokenizer = memory, Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        symbols, ranks = byte_of_symbol(), {}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special:
                stem = token.removesuffix("</w>")
                ranks[bytes(symbols[c] for c in stem) + WORD_END * (stem != token)] = i
        ranks[WORD_END] = max(ranks.values()) + len(special) + 1  # never left over
        self.merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks,
                                       special_tokens={})._encode_single_piece

    def __missing__(self, stretch: str) -> bytes:
        ids = array.array("I")
        for word in PATTERN.findall(stretch):
            ids.extend(self.merge(word.encode() + WORD_END))
        packed = ids.tobytes()
        if len(self) < self.memory and len(stretch) < 64:
            self[stretch] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers in native (little-endian) order."""
        if _FAR.search(text) or self.special.search(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
