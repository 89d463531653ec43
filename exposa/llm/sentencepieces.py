"""SentencePiece BPE encoding by backtracking, and decoding (op 9).

A row of tokens is the one that merging by score ends with exactly if every two neighbours are
compatible: merging the two tokens' joined string gives the two tokens again. So the encoder walks
the text from the left, takes the longest vocabulary piece found by an Aho-Corasick automaton, checks
it against the token before, tries shorter pieces, and steps back when none fits. The tokens of a
prefix are unique, so a position from which no way led on needs no second visit: a bitfield keeps
these positions. Compatibility is found by re-merging the two strings and remembered.

No piece of the vocabulary has a space mark after another character (checked on loading), so a text
is encoded word by word, and each worker remembers the first ``MEMORY`` short words it meets.
A word is cut first where no piece holds the two neighbours. The model's
own normaliser prepares the text; characters outside the vocabulary become byte pieces. Decoding is
the library's ``decode(ids)``.

Defined results: a null text is the empty text (no ids, decoded to the empty text); a null doc_id
stays null; repeated rows give a row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, text_of

#: Words a worker remembers, and their greatest length.
MEMORY, SHORT = 800_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1_000_000
SPACE = "▁"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Backtracking:
    def __init__(self, model_path: str, memory: int = MEMORY):
        import ahocorasick
        import sentencepiece
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space mark inside: words cannot be encoded apart")
        self.characters = {p for p in self.id if len(p) == 1}
        self.joined = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(self.merged(p)) == 1:  # else merging never ends with this piece
                self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.memory = memory

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the neighbours whose joined piece scores highest, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        x, y = self.piece[a], self.piece[b]
        ok = self.merged(x + y) == [x, y]
        if len(self.fits) < PAIRS:
            self.fits[a << 32 | b] = ok
        return ok

    def tokens(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        n, fits = len(text), self.fits
        starts: list[list[tuple[int, int]]] = [[] for _ in text]  # by rising length, as matches end
        for last, match in self.automaton.iter(text):
            starts[last - match[1]].append(match)
        out: list[int] = []
        trail: list[int] = []
        failed = at = before = 0
        while at < n:
            options = starts[at]
            while options:
                i, reach = options.pop()
                end = at + reach + 1
                if failed and failed >> end & 1:
                    continue
                if at:
                    ok = fits.get(before | i)
                    if not (self.compatible(out[-1], i) if ok is None else ok):
                        continue
                out.append(i)
                trail.append(at)
                at, before = end, i << 32
                break
            else:
                if not out:
                    raise ValueError("no row of pieces gives this text")
                failed |= 1 << at
                out.pop()
                at = trail.pop()
                before = out[-1] << 32 if out else 0
        return out

    def parted(self, word: str) -> Iterator[str]:
        """The word cut between neighbours outside ``joined``: no piece holds such a pair."""
        at, joined = 0, self.joined
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in joined:
                yield word[at:k]
                at = k
        yield word[at:]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered if it is short. Characters outside the vocabulary never merge, so
        words part there too."""
        if (ids := self.words.get(word)) is not None:
            return ids
        out: list[int] = []
        known_all = self.characters.issuperset(word)
        for known, run in ((True, word),) if known_all else itertools.groupby(word, self.characters.__contains__):
            text = "".join(run)
            if not known:
                out += [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown] * len(text)
                continue
            for part in self.parted(text):
                out += self.tokens(part) if part == word else self.word(part)
        ids = tuple(out)
        if len(word) <= SHORT and len(self.words) < self.memory:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        text = self.model.normalize(text)
        out: list[int] = []
        run = ""  # space marks of words that have nothing else
        remembered, word = self.words.get, self.word
        first, *rest = text.split(SPACE)
        if first:
            out += word(first)
        for w in rest:
            if not w:
                run += SPACE
                continue
            key = f"{run}{SPACE}{w}"
            out += remembered(key) or word(key)
            run = ""
        if run:
            out += word(run)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Backtracking:
    return Backtracking(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])


def encode(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, ids, decoded."""
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            e = encoder(path)
            ids = [e.encode(t) for t in rows.column("text").to_pylist()]
            yield batch(ENCODED, {"doc_id": rows.column("doc_id"), "ids": ids,
                                  "decoded": [e.model.decode(x) for x in ids]})

    return in_batches(_inputs(documents), run, "doc_id long, ids array<int>, decoded string")


def digests(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids out of Python."""
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            e = encoder(path)
            out: dict[str, list] = {f.name: [] for f in DIGEST}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = e.encode(text)
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(e.model.decode(ids).encode()).hexdigest())
            yield batch(DIGEST, out)

    return in_batches(_inputs(documents), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _inputs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
