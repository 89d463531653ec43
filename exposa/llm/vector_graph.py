"""Approximate nearest neighbours with a robust-pruned directed graph per shard (op 8).

Equal vectors are one point (with the smallest ``k`` + 1 of its ids, all that an answer can need). Points
are dealt by hash into shards of about ``SHARD`` points. A task builds a shard's graph: starting from
random edges, a greedy beam search from the shard's central point proposes neighbours for each point;
pruning keeps a candidate only if no kept neighbour is nearer to it by the factor ``ALPHA``, so short
and long edges of all directions remain; kept edges are added in reverse and pruned where a point has
too many. The index is a table of one row per shard in the shared folder. Blocks of queries go to every
shard of their dimension, whose task reads the shard once and then one block after the other; a beam search
there returns the nearest found, and the best ``k`` of all shards are kept. Every vector is indexed; nothing
is sampled.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no part;
vectors are only compared within their dimension; a query does not find its own vec_id, however many
rows have it; rows with a null vec_id take no part; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored. Rows that repeat a vec_id are one candidate if their vectors are
equal, else several, of which the nearest counts; a repeated query id is answered for its first vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize, ship_package

SHARD = 4096
#: Out-degree, beam of the building search, and relaxation of the pruning.
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Beam of queries, nodes expanded in a step, points searched together, queries of a block.
QUERY_BEAM, WIDTH, TOGETHER, QUERY_BLOCK = 128, 4, 256, 1000
#: Edges a node may gather before it is pruned, and distances that a step of the pruning holds.
SLACK, PRUNE_CELLS = DEGREE + DEGREE // 2, 1 << 21


class Graph:
    """``x``: the vectors; ``edges``: n x SLACK ids, padded with -1. Searching and pruning work on
    32-bit floats and many points at once; scores are taken from ``x`` in double precision."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, start: int | None = None):
        self.x = x.astype(np.float64, copy=False)
        scale = np.abs(self.x).max(initial=0.0) or 1.0  # 32-bit squares stay in range
        self.y = (self.x / scale).astype(np.float32)
        self.scale = scale
        self.norm = np.einsum("ij,ij->i", self.y, self.y)
        self.start = int(((self.y - self.y.mean(axis=0)) ** 2).sum(axis=1).argmin()) if start is None else start
        self.edges = self._build() if edges is None else edges

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Beam search from the start point for each row of ``q`` (scaled): ids of the nearest found,
        nearest first, padded with -1."""
        b, n = len(q), len(self.y)
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)  # the last column is for the padding
        seen[:, [self.start, n]] = True
        ids[:, 0] = self.start
        dist[:, 0] = ((q - self.y[self.start]) ** 2).sum(axis=1)
        square = (q ** 2).sum(axis=1)[:, None]
        while True:
            open_dist = np.where(done, np.float32(np.inf), dist)
            at = np.argpartition(open_dist, WIDTH - 1, axis=1)[:, :WIDTH]
            opened = np.isfinite(open_dist[rows, at])
            live = np.flatnonzero(opened.any(axis=1))
            if not len(live):
                return ids
            r = live[:, None]
            nodes = np.where(opened[live], ids[r, at[live]], 0)
            done[r, at[live]] = True
            new = np.where(opened[live][:, :, None], self.edges[nodes], -1).reshape(len(live), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[r, new]] = -1
            seen[r, new] = True
            d = self.norm[new] - 2 * (self.y[new] @ q[live][:, :, None])[:, :, 0] + square[live]
            d[new < 0] = np.inf
            all_ids, all_dist = np.hstack([ids[live], new]), np.hstack([dist[live], d])
            all_done = np.hstack([done[live], np.zeros(new.shape, bool)])
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            k = np.arange(len(live))[:, None]
            ids[live], dist[live], done[live] = all_ids[k, best], all_dist[k, best], all_done[k, best]

    def prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each point at most DEGREE of its row of candidates, nearest first, none of them relaxedly
        nearer to a kept one; padded with -1 to SLACK."""
        out = np.full((len(points), SLACK), -1)
        step = max(1, PRUNE_CELLS // candidates.shape[1] ** 2)
        for at in range(0, len(points), step):
            p, c = points[at:at + step], np.sort(candidates[at:at + step], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            c[c == p[:, None]] = -1
            d = self.norm[c] - 2 * (self.y[c] @ self.y[p][:, :, None])[:, :, 0] + self.norm[p][:, None]
            d[c < 0] = np.inf
            rows = np.arange(len(p))
            order = np.argsort(d, axis=1, kind="stable")
            c, d = c[rows[:, None], order], d[rows[:, None], order]
            y = self.y[c]
            between = self.norm[c][:, :, None] + self.norm[c][:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            alive = np.isfinite(d)
            for k in range(DEGREE):
                i = alive.argmax(axis=1)
                has = alive[rows, i]
                if not has.any():
                    break
                out[at:at + step][has, k] = c[rows, i][has]
                alive &= ALPHA * ALPHA * between[rows, i] > d
                alive[rows, i] = False
        return out

    def _build(self) -> np.ndarray:
        n = len(self.y)
        rng = np.random.default_rng(1)
        self.edges = np.full((n, SLACK), -1)
        if n <= SLACK:
            self.edges[:, :n] = np.where(np.eye(n, dtype=bool), -1, np.arange(n))
            return self.edges
        self.edges[:, :DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
        order = rng.permutation(n)
        for at in range(0, n, TOGETHER):
            points = order[at:at + TOGETHER]
            near = self.search(self.y[points], BEAM)
            kept = self.prune(points, np.hstack([near, self.edges[points]]))
            self.edges[points] = kept
            # each kept edge in reverse, gathered by the node it leads to
            to, source = kept.ravel(), np.repeat(points, SLACK)
            to, source = to[to >= 0], source[to >= 0]
            by = np.argsort(to, kind="stable")
            nodes, first, count = np.unique(to[by], return_index=True, return_counts=True)
            added = np.full((len(nodes), count.max()), -1)
            added[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = source[by]
            both = np.sort(np.hstack([self.edges[nodes], added]), axis=1)[:, ::-1]
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = np.sort(both, axis=1)[:, ::-1]
            over = (both >= 0).sum(axis=1) > SLACK
            self.edges[nodes[~over]] = both[~over][:, :SLACK]
            if over.any():
                self.edges[nodes[over]] = self.prune(nodes[over], both[over])
        return self.edges


def nearest(graph: Graph, ids: list[list[int]], query_ids: list[int], q: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query_id, vec_id, score) of each query's k nearest found in one shard."""
    for at in range(0, len(q), TOGETHER):
        found = graph.search((q[at:at + TOGETHER] / graph.scale).astype(np.float32), max(QUERY_BEAM, 4 * k))
        for query_id, v, points in zip(query_ids[at:at + TOGETHER], q[at:at + TOGETHER], found):
            points = points[points >= 0]
            score = np.sqrt(((graph.x[points] - v) ** 2).sum(axis=1))
            hits = sorted((s, i) for s, p in zip(score.tolist(), points.tolist()) for i in ids[p] if i != query_id)
            for s, i in hits[:k]:
                yield query_id, i, s


def usable(vector: Column) -> Column:
    return (F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))


INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("start", pa.int32()), ("vectors", pa.binary()),
                   ("edges", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame, k: int, shard_size: int = SHARD) -> tuple[DataFrame, dict[int, int]]:
    """The index table, and each dimension's number of shards. ``vectors``: vec_id, v."""
    ship_package(vectors.sparkSession)
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = (vectors.distinct().withColumn("rn", first).where(F.col("rn") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
              .withColumn("dim", F.size("v")))
    points = materialize(points)
    shards = {r["dim"]: max(1, math.ceil(r["count"] / shard_size)) for r in points.groupBy("dim").count().collect()}
    of_dim = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("dim")) if shards else F.lit(1)

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        g = Graph(_matrix(group.column("v"), dim))
        return pa.Table.from_batches([batch(INDEX, {
            "dim": [dim], "shard": [shard], "start": [g.start], "vectors": [g.x.tobytes()],
            "edges": [g.edges.astype(np.int32).tobytes()], "ids": [group.column("ids").to_pylist()]})])

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), of_dim).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, start int, vectors binary, edges binary, ids array<array<bigint>>")), shards


def search(embeddings: DataFrame, is_query: Column, k: int = 10, shard_size: int = SHARD,
           vector: str = "embedding") -> DataFrame:
    """Per query: query_id, rank, vec_id, score of its k nearest found among all other rows."""
    vectors = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q"))
               .where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    index, shards = build_index(vectors.select("vec_id", "v"), k, shard_size)
    queries = vectors.where("q").select("vec_id", "v", F.size("v").alias("dim")).groupBy("vec_id").agg(
        F.min_by(F.struct("dim", "v"), F.xxhash64("v")).alias("x")).select("vec_id", "x.dim", "x.v")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    of_dim = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("dim")) if shards else F.lit(1)
    # a row for each block of queries; a block holds about QUERY_BLOCK queries
    packed = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
              .groupBy("dim", "block").agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("v").alias("qs")))
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), of_dim - 1)))
    # a task reads a shard, then the blocks sent to it one by one: nothing is joined, so nothing is broadcast
    both = index.withColumn("block", F.lit(-1)).unionByName(sent, allowMissingColumns=True)
    tasks = max(1, 2 * sum(shards.values()))  # twice as many as shards, so that few get several
    dealt = both.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = g = ids = None
        for rows in batches:
            for i in range(rows.num_rows):
                row = {name: rows.column(name)[i] for name in rows.schema.names}
                at, dim = (row["dim"].as_py(), row["shard"].as_py()), row["dim"].as_py()
                if row["block"].as_py() < 0:
                    x = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
                    edges = np.frombuffer(row["edges"].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
                    shard, g, ids = at, Graph(x, edges, row["start"].as_py()), row["ids"].as_py()
                elif shard == at:  # a shard that got no points has no row
                    q = row["qs"].values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    hits = list(nearest(g, ids, row["query_ids"].as_py(), q, k))
                    yield batch(HIT, {f.name: list(c) for f, c in zip(HIT, zip(*hits) if hits else [[]] * 3)})

    hits = in_batches(dealt, run, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (best.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
