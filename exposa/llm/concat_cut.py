"""Packing by concatenating and cutting (op 13).

All documents' ids stand in one long row, cut into windows of ``capacity`` ids, wherever that falls.

* First pass: each task encodes its documents and writes, beside a document's ids, how many ids of the task
  come before it. The tasks' totals are one number per task.
* The totals' prefix sums give each task's place in the row, so the second pass knows each document's place
  by an addition. It cuts documents at window borders; every piece is a record of what lies between two
  borders (a document's or a window's): document, place in it, window, place there, check sum.
* ``sequences`` gives the windows' ids. A window whose ids all come to one task is whole at once; the
  others, at the edges of what a task reads, are boundary records of their windows, and only those are
  shuffled and joined. A window never holds more than ``capacity`` ids, however many tasks share it.

The row's end, shorter than a window, becomes sequences of descending powers of two, which need no padding.

Defined results: a null text is the empty text, a piece of one id (the end id); a null doc_id stays null;
rows that repeat a doc_id are packed each; a document of any length is cut as often as windows end in it; an
empty table gives an empty result; other columns are ignored. The order of documents is that of reading.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm import word_bpe
from exposa.llm.common import batch, in_batches, materialize, text_of

CAPACITY = 4096
END_ID = 2

TOKENS = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
                    ("ids", pa.binary())])
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
CHUNK = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("whole", pa.bool_())])


def encoded(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """part (the task), before (ids of the task before the document), doc_id, n, ids (unsigned 32-bit
    little-endian integers, the end id last); a table in the shared folder."""
    path = tokenizer_path or word_bpe.default_path()
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in TOKENS}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = word_bpe.encoder(path).packed(text) + end
                for f, v in zip(TOKENS, (part, before, doc_id, len(ids) // 4, ids)):
                    out[f.name].append(v)
                before += len(ids) // 4
            yield batch(TOKENS, out)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return materialize(in_batches(docs, run, "part long, before long, doc_id long, n long, ids binary"))


class Row:
    """The long row of ids: where each task's ids begin, and the windows it is cut into."""

    def __init__(self, totals: dict[int, int], capacity: int):
        base = np.zeros(max(totals, default=-1) + 2, np.int64)
        for part, n in totals.items():
            base[part + 1] = n
        self.base = np.cumsum(base)
        self.capacity, self.full = capacity, int(self.base[-1]) // capacity
        rest = int(self.base[-1]) % capacity
        self.tail, at = [], self.full * capacity  # (begin, length) of the last, short sequences
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append((at, 1 << bit))
                at += 1 << bit

    def length(self, sequence: int) -> int:
        return self.capacity if sequence < self.full else self.tail[sequence - self.full][1]

    def cuts(self, part: int, before: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document."""
        first = at = int(self.base[part]) + before
        while at < first + n:
            sequence = at // self.capacity
            begin, length = sequence * self.capacity, self.capacity
            if sequence == self.full:
                k = next(k for k, (b, m) in enumerate(self.tail) if at < b + m)
                sequence, (begin, length) = sequence + k, self.tail[k]
            stop = min(first + n, begin + length)
            yield at - first, stop - at, sequence, at - begin
            at = stop


def long_row(tokens: DataFrame, capacity: int = CAPACITY) -> Row:
    """One total for each task of the first pass comes to the driver."""
    return Row(dict(tokens.groupBy("part").agg(F.sum("n")).collect()), capacity)


def pieces(tokens: DataFrame, row: Row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in PIECE}
            for part, before, doc_id, n, ids in zip(*(rows.column(f.name).to_pylist() for f in TOKENS)):
                for start, length, sequence, offset in row.cuts(part, before, n):
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    for f, v in zip(PIECE, (doc_id, start, length, crc, n, sequence, offset)):
                        out[f.name].append(v)
            yield batch(PIECE, out)

    return in_batches(tokens, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                   "sequence_id long, offset long")


def sequences(tokens: DataFrame, row: Row) -> DataFrame:
    """sequence_id, ids: the packed sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = -1, 0, bytearray()  # the window being filled, from ``first`` on

        def chunk():
            done.append((now, first, bytes(held), first == 0 and len(held) == 4 * row.length(now)))

        for rows in batches:
            done: list[tuple] = []
            for part, before, _, n, ids in zip(*(rows.column(f.name).to_pylist() for f in TOKENS)):
                for start, length, sequence, offset in row.cuts(part, before, n):
                    if sequence != now or offset != first + len(held) // 4:
                        if held:
                            chunk()
                        now, first, held = sequence, offset, bytearray()
                    held += ids[4 * start:4 * (start + length)]
            yield batch(CHUNK, dict(zip(CHUNK.names, map(list, zip(*done)))) if done else {n: [] for n in CHUNK.names})
        if held:
            done = []
            chunk()
            yield batch(CHUNK, dict(zip(CHUNK.names, map(list, zip(*done)))))

    chunks = materialize(in_batches(tokens, run, "sequence_id long, offset long, ids binary, whole boolean"))
    joined = (chunks.where("NOT whole").groupBy("sequence_id")
              .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
              .select("sequence_id", F.expr("aggregate(parts, cast('' AS binary), (a, x) -> concat(a, x.ids)) AS ids")))
    return chunks.where("whole").select("sequence_id", "ids").unionByName(joined)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = encoded(documents, tokenizer_path)
    return pieces(tokens, long_row(tokens, capacity))
