"""Best-fit packing of documents into fixed-length sequences by bin completion (op 4).

Pieces of one length are interchangeable, so the packing problem is a histogram of at most
``capacity`` lengths however many documents there are. The driver solves that histogram:

* best-fit decreasing gives the first incumbent;
* bin completion, a branch and bound, fills one kind of sequence at a time around the largest piece left:
  it tries a few promising fillings of the rest from the least waste on, then lazily all maximal ones,
  applies each as often as the counts allow, then all fewer times, and prunes a branch when its waste shows
  that the incumbent cannot be beaten. It ends when the incumbent meets the lower bound, when all is
  tried, or after ``NODES`` nodes and dead ends, with the incumbent.

The result is a list of patterns (at most a few thousand, for any input), each with a number of
sequences. On the executors each piece gets a rank among the pieces of its length (ranked within salted
shares of the length, so that a common length has many tasks), and the rank tells its place in a pattern.

Defined results: a null text is the empty text, a piece of one id (the end id); a null doc_id stays null;
rows that repeat a doc_id are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.llm import bpe
from exposa.llm.common import batch, in_batches, materialize, text_of

CAPACITY = 2048
END_ID = 0
#: Nodes of the search, fillings tried at a node, and pieces that a filling's last exchange looks at.
NODES, FILLINGS = 20_000, 6
#: Shares in which the pieces of one length are ranked, at least.
SHARES = 64

Pattern = tuple[int, ...]  # piece lengths of a sequence, largest first


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """The bound of Martello and Toth: pieces over half a sequence cannot share, and what does not fit
    beside them needs sequences of its own; the best over all small sizes k."""
    n, size = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    for length, count in histogram.items():
        n[length] = count
    total = n * size
    best = -(-int(total.sum()) // capacity)
    count_upto, total_upto = np.cumsum(n), np.cumsum(total)
    for k in range(1, capacity // 2 + 1):
        alone = int(count_upto[-1] - count_upto[capacity - k])  # nothing of size k fits beside
        large = int(count_upto[capacity - k] - count_upto[capacity // 2])
        large_total = int(total_upto[capacity - k] - total_upto[capacity // 2])
        small_total = int(total_upto[capacity // 2] - total_upto[k - 1])
        best = max(best, alone + large + max(0, -(-(small_total - (large * capacity - large_total)) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over counts: pattern -> number of sequences."""
    rest: dict[int, Counter] = defaultdict(Counter)  # free space -> patterns
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = min((s for s in rest if s >= length and rest[s]), default=capacity)
            # the fullest sequence that fits stays the fullest until the piece no longer fits
            times = space // length
            if rest[space]:
                pattern, have = next(iter(rest[space].items()))
            else:
                pattern, have = (), left
            take = min(have, left // times)
            if not take:
                take, times = 1, left
            if pattern:
                rest[space][pattern] -= take
                if not rest[space][pattern]:
                    del rest[space][pattern]
            rest[space - times * length][pattern + (length,) * times] += take
            left -= take * times
    return sum(rest.values(), Counter())


def fillings(space: int, lengths: list[int], left: dict[int, int], many: int = FILLINGS) -> list[Pattern]:
    """Promising fillings of ``space`` from the pieces left, least waste first, at most ``many``.

    A filling dominates another of no less sum whose pieces can be grouped into its pieces; here: fewer
    and larger pieces go before more and smaller ones of the same sum, and a sum is kept once."""
    best: dict[int, Pattern] = {0: ()}  # sum -> its filling of largest pieces
    usable = [x for x in lengths if x <= space]
    have = set(usable)
    for x in usable:  # one piece
        best.setdefault(x, (x,))
    for i, x in enumerate(usable):  # the largest piece and the best partner
        if x * 2 < space and space in best:
            break
        for y in _nearest(space - x, usable, x, have):
            if left[y] > (x == y) and x + y not in best:
                best[x + y] = (x, y)
    if space not in best:  # greedy completions, each from another largest piece
        for x in usable[:: max(1, len(usable) // 64)]:
            filling, room, used = [x], space - x, Counter([x])
            while room:
                y = next((y for y in _nearest(room, usable, room, have) if left[y] > used[y]), 0)
                if not y:
                    break
                filling.append(y)
                used[y] += 1
                room -= y
            best.setdefault(space - room, tuple(sorted(filling, reverse=True)))
            if not room:
                break
    return [best[s] for s in sorted(best, reverse=True)[:many]]


def all_fillings(space: int, lengths: list[int], left: dict[int, int]) -> Iterator[Pattern | None]:
    """Every maximal filling (no piece left fits the rest), largest pieces first; None for a dead end."""
    total = [0]
    for x in reversed(lengths):
        total.append(total[-1] + x * left[x])
    total.reverse()  # of the pieces from a length on
    todo: list[tuple[int, int, int, Pattern]] = [(0, space, space + 1, ())]
    while todo:
        i, room, must, filling = todo.pop()  # the rest must be less than ``must``
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if room - total[i] >= must:
            yield None
        elif i == len(lengths):
            yield filling
        else:
            x = lengths[i]
            most = min(left[x], room // x)
            for k in range(most + 1):
                todo.append((i + 1, room - k * x, must if k == left[x] else min(must, x), filling + (x,) * k))


def branches(largest: int, space: int, before: dict[int, int]) -> Iterator[tuple[Pattern, int] | None]:
    """(pattern, times) around the largest piece: the most promising fillings as often as they go, then all
    others, then all fewer times; None for a dead end."""
    left = dict(before)
    left[largest] -= 1
    lengths = sorted((k for k, v in left.items() if v), reverse=True)

    def most(pattern: Pattern) -> int:
        return min(before[k] // n for k, n in Counter(pattern).items())

    first = fillings(space, lengths, left)
    for f in first:
        yield (largest, *f), most((largest, *f))
    for f in all_fillings(space, lengths, left):
        if f is None or f not in first:
            yield f if f is None else ((largest, *f), most((largest, *f)))
    for f in all_fillings(space, lengths, left):
        if f is None:
            yield None
        else:
            for times in range(most((largest, *f)) - 1, 0, -1):
                yield (largest, *f), times


def _nearest(room: int, usable: list[int], most: int, have: set[int]) -> list[int]:
    """The largest usable lengths up to ``room`` and ``most`` (``usable`` falls)."""
    limit = min(room, most)
    if limit in have:
        return [limit]
    lo, hi = 0, len(usable)
    while lo < hi:
        mid = (lo + hi) // 2
        if usable[mid] > limit:
            lo = mid + 1
        else:
            hi = mid
    return usable[lo:lo + 3]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers of sequences, using every piece once."""
    histogram = {k: v for k, v in histogram.items() if v}
    full = histogram.pop(capacity, 0)
    best = best_fit(histogram, capacity)
    bound, total = lower_bound(histogram, capacity), sum(k * v for k, v in histogram.items())
    budget = nodes
    # a path of choices: (pieces left, sequences used, waste, branches not tried yet, choices before)
    path: list[list] = []
    state, used, waste, chosen = dict(histogram), 0, 0, []
    while sum(best.values()) > bound and budget > 0:
        budget -= 1
        allowed = (sum(best.values()) - 1) * capacity - total
        if state and waste <= allowed and used + lower_bound_fast(state, capacity) < sum(best.values()):
            largest = max(state)
            path.append([state, used, waste, branches(largest, capacity - largest, state), len(chosen)])
        elif not state and used < sum(best.values()):
            best = Counter()
            for pattern, times in chosen:
                best[pattern] += times
        option = None
        while path and option is None and budget > 0:
            option = next(path[-1][3], ())
            if option is None:
                budget -= 1
            elif not option:
                path.pop()
                option = None
        if option is None:
            break
        before, used, waste, _, depth = path[-1]
        pattern, times = option
        need = Counter(pattern)
        del chosen[depth:]
        chosen.append((pattern, times))
        state = dict(before)
        for k, n in need.items():
            state[k] -= n * times
            if not state[k]:
                del state[k]
        used, waste = used + times, waste + times * (capacity - sum(pattern))
    out = sorted(best.items(), reverse=True)
    return ([((capacity,), full)] if full else []) + out


def lower_bound_fast(histogram: dict[int, int], capacity: int) -> int:
    return -(-sum(k * v for k, v in histogram.items()) // capacity)


class Places:
    """Where the piece of a given rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows: dict[int, list] = defaultdict(list)
        taken: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for length in pattern:
                rows[length].append((taken[length], sequence, offset))
                taken[length] += times
                offset += length
            sequence += times
        self.rows = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            own = length == k
            first, base, start = self.rows[int(k)]
            at = np.searchsorted(first, rank[own], "right") - 1
            sequence[own], offset[own] = base[at] + rank[own] - first[at], start[at]
        return sequence, offset


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("text_crc32", pa.int64())])
PLACED = pa.schema([*list(PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences, and what is over first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or bpe.default_path()
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in PIECE}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = bpe.encoder(path).packed(text) + end
                whole = zlib.crc32(ids)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    values = (doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), whole)
                    for f, v in zip(PIECE, values):
                        out[f.name].append(v)
            yield batch(PIECE, out)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return in_batches(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, text_crc32 long")


def ranked(cut_pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0: its rank within its share plus the
    pieces of the shares before. The counts of the shares are a small table."""
    spark = cut_pieces.sparkSession
    shares = max(SHARES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut_pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "text_crc32"), F.lit(shares)))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    first = (salted.groupBy("length", "share").agg(F.count("*").alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "text_crc32"))
    return (salted.withColumn("within", within - 1).join(first, ["length", "share"])
            .withColumn("rank", F.col("first") + F.col("within")))


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_pieces = materialize(pieces(documents, capacity, tokenizer_path))
    histogram = dict(cut_pieces.groupBy("length").count().collect())  # at most ``capacity`` rows
    places = Places(solve(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sequence, offset = places.find(rows.column("length").to_numpy(), rows.column("rank").to_numpy())
            yield batch(PLACED, {f.name: rows.column(f.name) for f in list(PLACED)[:5]}
                        | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return in_batches(ranked(cut_pieces).select(*columns, "rank"), run,
                      "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
