"""SimHash near-duplicates with the generalised pigeonhole principle (op 3).

*Fingerprints.* A bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's word shingles.

*Candidates.* Equal fingerprints are one point. The 64 bits are dealt into partitions, correlated bits
together (correlations over all points). Each point gets a threshold per partition, one less than a
count u of differing bits, with the u adding up to ``max_bits`` + 1: two points within ``max_bits``
differ in fewer than u bits of some partition. The u are allocated by dynamic programming on what they
cost: the partition values to probe, and the candidates expected there, estimated from histograms of the
partitions' values over all points. So a point whose value in a partition is very common gives that
partition a small u, or none. The number of partitions follows the number of points.

*Verification.* Index rows and probes meet by (partition, value), sorted; tasks compare the whole
fingerprints in numpy and return, for each chunk of pairs, a spanning forest of the links found, so a
group of n points that are all alike gives fewer than n links a chunk, not n(n-1)/2. Very common values
are split into blocks of points, with the probes sent to each block. ``components`` joins the forests.

Defined results: a null text is the empty text; texts without words have fingerprint 0 and are linked
like others; a null doc_id gets its group's component, which is null only if all its doc_ids are; repeated
rows share a result; an empty table gives an empty result; other columns are ignored by ``near_duplicates``
and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize, text_of
from exposa.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Hashes whose bits are counted at a time, and pairs compared at a time.
CHUNK_HASHES, CHUNK_PAIRS = 1 << 16, 1 << 21
#: Bits of a partition that its histogram covers, and the largest count u of a partition.
HISTOGRAM_BITS, MAX_U = 16, 4
#: Points of one value beyond the average that make a block.
BLOCK = 8192
#: Cost of a probe and of comparing a candidate.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    counts, hash_of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK_HASHES):
        pairs = zip(starts[at:at + CHUNK_HASHES], ends[at:at + CHUNK_HASHES])
        h = np.array([hash_of(joined[a:b - 1], SEED) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint as a signed bigint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fp = np.array([fingerprint(t, shingle) for t in rows.column("text").to_pylist()], np.uint64)
            yield batch(schema, {"doc_id": rows.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return in_batches(docs, run, "doc_id long, fp long")


def _points(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_correlations(points: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all points; 4096 sums reach the driver."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for rows in batches:
            x = np.unpackbits(_points(rows).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        yield batch(schema, {"cell": np.arange(4096, dtype=np.int32), "n": total.ravel()})

    sums = dict(in_batches(points, count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
    both = np.array([sums.get(i, 0) for i in range(4096)], float).reshape(64, 64)
    n, ones = max(1, points.count()), np.diag(both)
    spread = np.sqrt(np.maximum(ones / n * (1 - ones / n), 1e-9))
    return (both / n - np.outer(ones, ones) / n**2) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of nearly equal size, each grown from its strongest pair by the
    bit most correlated with it."""
    strength, left, groups = np.abs(correlation), list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        pair = max(combinations(left, 2), key=lambda p: strength[p]) if size > 1 else (left[0],)
        group = list(pair)
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: strength[b, group].sum()))
        groups.append(group)
        left = [b for b in left if b not in group]
    return groups


def ball(width: int, u: int) -> int:
    """How many values differ from one in fewer than u of ``width`` bits."""
    return sum(math.comb(width, k) for k in range(u))


def best_parts(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of partitions that costs least for n evenly spread points."""
    def cost(parts: int) -> float:
        width, us = 64 // parts, [(max_bits + 1 + i) // parts for i in range(parts)]
        probes = sum(ball(width, u) for u in us)
        return PROBE_COST * probes + CANDIDATE_COST * probes * n / 2.0**width
    return min(range(2, max_bits + 1), key=cost)


@dataclass
class Plan:
    groups: list[list[int]]
    histogram: np.ndarray  # parts x 2**HISTOGRAM_BITS
    n: int
    max_bits: int

    def __post_init__(self):
        self.masks = [[self._masks(len(g), u) for u in range(MAX_U + 1)] for g in self.groups]
        self.cost = [self._costs(i) for i in range(len(self.groups))]

    @staticmethod
    def _masks(width: int, u: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(u) for c in combinations(range(width), k)], np.uint64)

    def _costs(self, i: int) -> np.ndarray:
        """(MAX_U + 1) x values: cost of each u for each value of the histogram's bits. Shells of values
        at distance k follow from those at k - 1: summing a shell over one-bit changes counts each value
        of the next shell k + 1 times and of the one before w - k + 1 times."""
        width = len(self.groups[i])
        w = min(width, HISTOGRAM_BITS)
        rest, values = width - w, np.arange(1 << w)
        shells = [self.histogram[i][:1 << w].astype(float)]
        for k in range(MAX_U - 1):
            moved = sum(shells[k][values ^ (1 << b)] for b in range(w))
            shells.append((moved - (w - k + 1) * shells[k - 1] if k else moved) / (k + 1))
        out = np.zeros((MAX_U + 1, 1 << w))
        for u in range(1, MAX_U + 1):
            near = sum(shells[k] * ball(rest, u - k) for k in range(u)) / 2.0**rest
            out[u] = PROBE_COST * ball(width, u) + CANDIDATE_COST * near
        return out

    def values(self, fp: np.ndarray) -> list[np.ndarray]:
        """The points' value in each partition; the histogram's bits are its lowest."""
        one = np.uint64(1)
        out = []
        for g in self.groups:
            v = np.zeros(len(fp), np.uint64)
            for k, b in enumerate(g):
                v |= (fp >> np.uint64(b) & one) << np.uint64(k)
            out.append(v)
        return out

    def low(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << HISTOGRAM_BITS) - 1)).astype(np.int64)

    def allocate(self, values: list[np.ndarray]) -> np.ndarray:
        """parts x points: the u of least total cost that add up to max_bits + 1."""
        goal, n = self.max_bits + 1, len(values[0])
        best = np.full((goal + 1, n), np.inf)
        best[0] = 0
        choice = []
        for i, v in enumerate(values):
            cost = self.cost[i][:, self.low(v)]
            new, took = np.full((goal + 1, n), np.inf), np.zeros((goal + 1, n), np.int64)
            for s in range(goal + 1):
                for u in range(min(MAX_U, s, len(self.groups[i])) + 1):
                    c = best[s - u] + cost[u]
                    better = c < new[s]
                    new[s][better], took[s][better] = c[better], u
            best = new
            choice.append(took)
        out, s, at = np.zeros((len(values), n), np.int64), np.full(n, goal), np.arange(n)
        for i in reversed(range(len(values))):
            out[i] = choice[i][s, at]
            s = s - out[i]
        return out

    def blocks(self, i: int, values: np.ndarray) -> np.ndarray:
        """Into how many blocks the points of a value are split."""
        average = self.n / (1 << min(HISTOGRAM_BITS, len(self.groups[i])))
        return np.ceil(self.histogram[i][self.low(values)] / (BLOCK + 4 * average)).astype(np.int64).clip(1, 1 << 20)


def make_plan(points: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None) -> Plan:
    n = points.count()
    groups = group_bits(bit_correlations(points), parts or best_parts(n, max_bits))
    plan = Plan(groups, np.zeros((len(groups), 1 << HISTOGRAM_BITS)), n, max_bits)
    schema = pa.schema([("part", pa.int32()), ("value", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), 1 << HISTOGRAM_BITS), np.int64)
        for rows in batches:
            for i, v in enumerate(plan.values(_points(rows))):
                total[i] += np.bincount(plan.low(v), minlength=1 << HISTOGRAM_BITS)
        for i in range(len(groups)):
            used = np.flatnonzero(total[i])
            yield batch(schema, {"part": np.full(len(used), i, np.int32), "value": used.astype(np.int32),
                                 "n": total[i][used]})

    rows = (in_batches(points, count, "part int, value int, n long")
            .groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas())
    histogram = np.zeros((len(groups), 1 << HISTOGRAM_BITS))
    histogram[rows["part"].to_numpy(int), rows["value"].to_numpy(int)] = rows["n"]
    return Plan(groups, histogram, n, max_bits)


MEET = pa.schema([("key", pa.int64()), ("probe", pa.int8()), ("fp", pa.int64())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _key(i: int, block: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.int64(i << 56) | block << 32 | value.astype(np.int64)


def meetings(points: DataFrame, plan: Plan) -> DataFrame:
    """Index rows (probe 0) and probes (1) of every point, by (partition, block, value)."""

    def rows_of(key: np.ndarray, probe: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield batch(MEET, {"key": pa.array(key), "probe": pa.array(np.full(len(key), probe, np.int8)),
                           "fp": pa.array(fp.view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fp = _points(rows)
            values = plan.values(fp)
            us = plan.allocate(values)
            for i, v in enumerate(values):
                spread = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield from rows_of(_key(i, spread % plan.blocks(i, v), v), 0, fp)
                for u in range(1, MAX_U + 1):
                    own = np.flatnonzero(us[i] == u)
                    if not len(own):
                        continue
                    masks = plan.masks[i][u]
                    step = max(1, 200_000 // len(masks))
                    for at in range(0, len(own), step):
                        some = own[at:at + step]
                        value = (v[some][:, None] ^ masks[None, :]).ravel()
                        point = np.repeat(fp[some], len(masks))
                        blocks = plan.blocks(i, value)
                        for b in range(int(blocks.max())):
                            sent = blocks > b
                            yield from rows_of(_key(i, np.full(int(sent.sum()), b, np.int64), value[sent]), 1, point[sent])

    return in_batches(points, run, "key long, probe byte, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links a-b: (node, least node of its component), without roots."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(points: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of points within max_bits."""
    max_bits = plan.max_bits

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b, size = [], [], 0
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for rows in batches:
            key, fp = rows.column("key").to_numpy(), _points(rows)
            probe = rows.column("probe").to_numpy() == 1
            index_key, index_fp = np.concatenate([held_key, key[~probe]]), np.concatenate([held_fp, fp[~probe]])
            probe_key, probe_fp = key[probe], fp[probe]
            first = np.searchsorted(index_key, probe_key, "left")
            n = np.searchsorted(index_key, probe_key, "right") - first
            hit = n > 0
            first, n, probe_fp = first[hit], n[hit], probe_fp[hit]
            upto = np.cumsum(n)
            at = 0
            while at < len(n):
                base = upto[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(upto, base + CHUNK_PAIRS, "right")))
                m = n[at:stop]
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                x, y = np.repeat(probe_fp[at:stop], m), index_fp[np.repeat(first[at:stop], m) + within]
                near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
                if near.any():
                    a, b = forest(x[near], y[near])
                    found_a.append(a)
                    found_b.append(b)
                    size += len(a)
                at = stop
            if len(key):
                last = index_key == key[-1]
                held_key, held_fp = index_key[last], index_fp[last]
            if size > 2_000_000:
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                yield batch(LINK, {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
                found_a, found_b, size = [], [], 0
        if size:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            yield batch(LINK, {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    met = meetings(points, plan).repartition("key").sortWithinPartitions("key", "probe")
    return in_batches(met, verify, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    parts: int | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    docs = materialize(fingerprints(documents, shingle))
    points = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    plan = make_plan(points.select("fp"), max_bits, parts)
    roots = components(links(points.select("fp"), plan))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(named, "root").select("fp", "component_id")
    return docs.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The document of smallest doc_id of each group, with all its columns."""
    kept = (near_duplicates(documents, shingle, max_bits).where("doc_id <=> component_id")
            .select(F.col("doc_id").alias("kept_id")).distinct())
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
