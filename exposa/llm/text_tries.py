"""Compressed radix tries over whole texts, and which row of equal texts comes first.

A node's edge holds a run of bytes; a text ends at one node, its terminal, which keeps the least id of the rows
with that text. Equal texts share a terminal by construction, so no digest decides equality.

``first_rows`` finds, over a whole table, the row of least id of each text:

1. Tasks insert texts into a trie of at most ``HELD`` bytes at a time. An in-order walk gives separators: at even
   distances in bytes the shortest prefix that parts two neighbouring texts, at most ``SEPARATOR`` bytes. Prefixes
   so adapt to the texts: short where they differ early, long inside a group that shares its beginning.
2. The separators, sorted and weighed as a table, are thinned to at most ``RANGES`` borders of about equal bytes.
   A range that stays too heavy (more than ``SEPARATOR`` bytes shared by many texts) is dealt among several
   owners by digest; equal texts meet in any case.
3. Tasks insert their texts again and send each one once with its least id to its range's owner, so copies of
   one text leave a task as one row. Owners insert what they get; the walk gives each text's least id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize

#: Bytes of text that a task holds in a trie before it walks it, and that an owner gets, about.
HELD, OWNED = 32 << 20, 64 << 20
#: Borders between ranges at most, and bytes of one.
RANGES, SEPARATOR = 65_536, 1024

BORDER = pa.schema([("border", pa.binary()), ("weight", pa.int64())])
OWN = pa.schema([("owner", pa.int32()), ("text", pa.binary()), ("least", pa.int64())])
FIRST = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


class Node:
    __slots__ = ("label", "least", "children")

    def __init__(self, label: bytes, least: int | None = None):
        self.label, self.least, self.children = label, least, {}


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, text: bytes, doc_id: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], doc_id)
                self.bytes += len(text) - at + 64
                return
            if not text.startswith(child.label, at):
                k = common(child.label, text[at:at + len(child.label)])
                upper = Node(child.label[:k])
                upper.children[child.label[k]] = child
                child.label = child.label[k:]
                node.children[text[at]] = child = upper
            node, at = child, at + len(child.label)
        node.least = doc_id if node.least is None else min(node.least, doc_id)

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(text, least id) in the order of bytes."""
        todo = [(self.root, b"")]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.least is not None:
                yield text, node.least
            todo += [(node.children[b], text) for b in sorted(node.children, reverse=True)]


def tries(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[Trie]:
    """Tries of (text, doc_id) rows, each of about ``held`` bytes at most, or of one text."""
    trie = Trie()
    for rows in batches:
        for text, doc_id in zip(rows.column("text").to_pylist(), rows.column("doc_id").to_pylist()):
            trie.insert(text, doc_id)
            if trie.bytes >= held:
                yield trie
                trie = Trie()
    yield trie


def separators(trie: Trie, grain: int) -> Iterator[tuple[bytes | None, int]]:
    """(separator, bytes of texts since the one before), the last one with None."""
    before, weight = None, 0
    for text, _ in trie.walk():
        if weight >= grain and before is not None:
            yield text[:min(common(before, text) + 1, SEPARATOR)], weight
            weight = 0
        weight += len(text) + 64
        before = text
    if weight:
        yield None, weight


def in_columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return batch(schema, {f.name: [r[k] for r in rows] for k, f in enumerate(schema)})


def in_parts(schema: pa.Schema, rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += size(row) + 16
        if total >= 8 << 20:
            yield in_columns(schema, part)
            part, total = [], 0
    if part:
        yield in_columns(schema, part)


def weighed_borders(texts: DataFrame, held: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in tries(batches, held):
            yield from in_parts(BORDER, separators(trie, max(trie.bytes // 16, 1)), lambda r: len(r[0] or b""))

    return in_batches(texts, run, "border binary, weight long").groupBy("border").agg(F.sum("weight").alias("weight"))


def thinned(borders: DataFrame, target: int) -> list[tuple[bytes, int]]:
    """(border, bytes before it), in order: one whenever ``target`` bytes have come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, last = 0, None
        for rows in batches:
            out = []
            for border, own in zip(rows.column("border").to_pylist(), rows.column("weight").to_pylist()):
                weight, last = weight + own, border
                if weight >= target:
                    out.append((border, weight))
                    weight = 0
            yield in_columns(BORDER, out)
        if weight:
            yield in_columns(BORDER, [(last, weight)])

    ordered = borders.where("border IS NOT NULL").repartitionByRange("border").sortWithinPartitions("border")
    return sorted((bytes(b), w) for b, w in in_batches(ordered, run, "border binary, weight long").collect())


class Owners:
    """Who owns a text: its range between borders, and its digest where several share a range."""

    def __init__(self, borders: list[tuple[bytes, int]], rest: int, target: int):
        self.borders = [b for b, _ in borders]
        self.shares = [max(1, -(-w // target)) if w > 2 * target else 1 for w in [*(w for _, w in borders), rest]]
        self.first = [0]
        for n in self.shares:
            self.first.append(self.first[-1] + n)

    def of(self, text: bytes) -> int:
        k = bisect_right(self.borders, text)
        n = self.shares[k]
        return self.first[k] + (xxhash.xxh3_64_intdigest(text) % n if n > 1 else 0)

    def __len__(self) -> int:
        return self.first[-1]


def digest(text: bytes) -> bytes:
    """Tells apart rows of one id; equality of texts is the tries' matter."""
    return xxhash.xxh3_128_digest(text)


def first_rows(texts: DataFrame, held: int = HELD, owned: int = OWNED) -> DataFrame:
    """doc_id, digest: of each text of (doc_id long, text binary; neither null) the row of least id."""
    spark = texts.sparkSession
    borders = materialize(weighed_borders(texts, held))
    total = borders.agg(F.sum("weight"), F.sum(F.when(F.col("border").isNull(), F.col("weight")))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = max(min(owned, (total[0] or 0) // (2 * tasks) + 1), (total[0] or 0) // RANGES + 1)
    owners = Owners(thinned(borders, target), total[1] or 0, min(target, owned))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in tries(batches, held):
            yield from in_parts(OWN, ((owners.of(t), t, least) for t, least in trie.walk()), lambda r: len(r[1]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for rows in batches:
            for text, least in zip(rows.column("text").to_pylist(), rows.column("least").to_pylist()):
                trie.insert(text, least)
        yield from in_parts(FIRST, ((least, digest(text)) for text, least in trie.walk()), lambda r: 24)

    sent = in_batches(texts, send, "owner int, text binary, least long").repartitionById(len(owners), F.col("owner"))
    return in_batches(sent.select("text", "least"), find, "doc_id long, digest binary")
